import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import lattice


def all_cuts(run):
    if not run:
        return [[]]
    return [[run[:k], *rest] for k in range(1, len(run) + 1) for rest in all_cuts(run[k:])]


@given(st.text(alphabet="甲乙丙", max_size=8), st.dictionaries(st.text(alphabet="甲乙丙", min_size=1, max_size=4), st.integers(1, 50), max_size=12))
def test_the_path_is_the_best_of_all_cuts(run, counts):
    total = math.log(max(1, sum(counts.values())))
    weights = {w: math.log(n) - total for w, n in counts.items()}
    score = lambda cut: sum(weights.get(w, -total) for w in cut)
    found = lattice.best_path(run, weights, -total)
    allowed = [c for c in all_cuts(run) if all(len(w) == 1 or w in weights for w in c)]
    assert "".join(found) == run and all(len(w) == 1 or w in weights for w in found)
    assert score(found) >= max(map(score, allowed)) - 1e-9


def test_words_of_mixed_texts(spark):
    counts = spark.createDataFrame([("研究", 50), ("研究生", 20), ("生命", 40), ("命", 5), ("起源", 30), ("x" * 9, 9), ("", 3), ("无", 0)], "word string, n long")
    known = lattice.dictionary(counts)
    assert set(known) == {"研究", "研究生", "生命", "命", "起源"} and lattice.dictionary(counts, most=2) == {"研究": 50, "生命": 40}
    df = spark.createDataFrame([(1, "研究生命起源 GPT4,未知"), (2, None), (3, ""), (4, " 。!")], "id int, t string")
    got = {r.id: r.w for r in df.select("id", lattice.words("t", known).alias("w")).collect()}
    assert got == {1: ["研究", "生命", "起源", "GPT4", "未", "知"], 2: [], 3: [], 4: []}


def test_a_long_run(spark):
    df = spark.range(1).select(F.repeat(F.lit("研究生命"), 20_000).alias("t"))
    assert df.select(F.size(lattice.words("t", {"研究": 3, "生命": 2})).alias("n")).first().n == 40_000


def plain(text, known):
    """The words by ``best_path``, run by run."""
    total = math.log(max(1, sum(known.values())))
    weights = {w: math.log(n) - total for w, n in known.items()}
    parts = re.findall(r"[一-鿿]+|[^\W_一-鿿]+", text)
    return [w for p in parts for w in (lattice.best_path(p, weights, -total) if "一" <= p[0] <= "鿿" else [p])]


@pytest.mark.parametrize("limits", [{}, {"DENSE": 0}, {"FEW": 3, "LONG": 4, "RUN_CHARS": 20}, {"FEW": 1000, "LONG": 0, "RUN_CHARS": 7, "DENSE": 0}])
def test_runs_cut_together_are_cut_as_one_by_one(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lattice, name, value)
    rng = random.Random(5)
    for letters in ("甲乙", "甲乙丙丁鿿一", [chr(0x4E00 + rng.randrange(0x5200)) for _ in range(400)]):
        word = lambda n, letters=letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
        known = {word(9): rng.randint(1, 9) for _ in range(600)} | {"abc": 7, "x甲": 3}
        some = list(known)
        texts = ["".join(rng.choice([word(12), rng.choice(some), rng.choice(some), " ", "ab1", "é", "_", "。", "🦆", "㐀"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
        texts += [None, "", "甲", "甲" * 70, "".join(rng.choice(some) for _ in range(300))]
        for words in (known, {}):
            made = lattice.Lattice(*lattice.packed(words))
            got = made.words(pa.array(texts))
            got.validate(full=True)
            assert got.to_pylist() == [plain(t or "", words) for t in texts]
    assert made.words(pa.array([None, ""], pa.string())).to_pylist() == [[], []]


def test_kinds_of_all_code_points():
    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    of = {ord(c): k for k, pattern in ((lattice._CJK, "[一-鿿]"), (lattice._OTHER, r"[^\W_一-鿿]")) for c in re.findall(pattern, text)}
    assert lattice.kinds(points).tolist() == [of.get(p, lattice._NONE) for p in points.tolist()]


def test_many_runs_take_less_time_than_one_by_one(spark):
    rng = random.Random(7)
    known = {"".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randint(1, 8))): rng.randint(1, 9) for _ in range(20_000)}
    some = list(known)
    texts = ["。".join("".join(rng.choice(some) for _ in range(rng.randint(1, 9))) for _ in range(100)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(1).cache()
    assert rows.count() == 400
    found = rows.select("id", lattice.words("t", known).alias("w"))
    rows.limit(1).select(lattice.words("t", known)).collect()
    start = time.perf_counter()
    n = found.agg(F.sum(F.size("w"))).first()[0]
    together = time.perf_counter() - start
    start = time.perf_counter()
    assert sum(len(plain(t, known)) for t in texts) == n
    assert together < 0.6 * (time.perf_counter() - start)
    rows.unpersist()
