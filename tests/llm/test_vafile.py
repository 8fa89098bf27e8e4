import math
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import vafile


def brute(rows, entries=256, rounds=4):
    """(vec_id, code, error) of each usable row, and the codebooks, with Python's integers."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    sub = -(-width // 4)
    ints = [[math.floor(1024 * x) for x in v] + [0] * (4 * sub - width) for _, v, _ in kept]
    parts = [[v[p * sub : (p + 1) * sub] for v in ints] for p in range(4)]
    books = [[list(e) for e in ps[:entries]] for ps in parts]
    near = lambda v, b: min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), i) for i, e in enumerate(b))
    for _ in range(rounds):
        for p in range(4):
            codes = [near(v, books[p])[1] for v in parts[p]]
            for e in set(codes):
                mine = [v for v, c in zip(parts[p], codes, strict=True) if c == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    told = [[near(parts[p][i], books[p]) for p in range(4)] for i in range(len(kept))]
    return [(r[0], "".join(f"{c:02x}" for _, c in t), min(sum(d for d, _ in t), 2**63 - 1), r[2]) for r, t in zip(kept, told, strict=True)], books


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("own") for c in ("code", "error", "part", "n")})
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vafile.compress(df).collect())
    want, books = brute(rows)
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {}
    for *_, error, label in want:
        by_label[label] = by_label.get(label, 0) + error
    assert got == sorted((i is None, i or 0, code, error, min(by_label[label], 2**63 - 1), digest) for i, code, error, label in want)


def test_small_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i) * 3, rng.normal(size=8).round(3).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(600)]
    rows += [(5, [0.0] * 8, 1), (5, [0.0] * 8, 1), (7, None, 1), (8, [], 1), (9, [1.0, None] * 4, 1), (10, [float("nan")] * 8, 2), (11, [float("inf")] * 8, 2), (None, [0.5] * 8, None), (12, [1.0] * 4, 1), (13, rows[0][1], 2)]
    check(spark, rows)


def test_odd_widths_and_sizes(spark):
    check(spark, [(i, [float(i % 7), -float(i), 0.3, 2.0, i / 3, -0.0001], 1) for i in range(40)])  # a width that 4 does not divide
    check(spark, [(1, [0.25] * 4, None)])
    check(spark, [(i, [1e9 * i, -1e6, 3e5 * i, 1e-9], i % 2) for i in range(30)])
    check(spark, [(1, [1e300, 1.0, -1e300, 5.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1), (3, [1e300, 1.5, 7.0, 4.0], None)])
    assert vafile.compress(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0
    assert vafile.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")).count() == 0


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, (256, 16))
    rows = centres[rng.integers(0, 256, 500)] + rng.integers(-200, 200, (500, 16))
    e = vafile.Entries(centres)
    low, high = e.bounds(rows)
    exact = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (low <= exact * 1.0001 + 1).all() and (high >= exact * 0.9999 - 1).all()
    assert (low <= high.min(axis=1, keepdims=True)).mean() < 0.5
    code, distance = e.nearest(rows)
    assert (code == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
