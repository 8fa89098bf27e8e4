import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import minhash


def brute(rows, percent=85):
    """(doc_id, n, component) of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").translate({k: k + 32 for k in range(65, 91)}).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d or -1, len(sets[i]), least.get(find(i), d) or -1) for i, (d, _) in enumerate(rows))


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("key", "cls", "n", "root", "c", "token", "id", "keys")})
    out = minhash.near_duplicates(df, **more).collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in out)
    return sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out)


def text(rng, n, letters="abcdefgh"):
    return [rng.choice(letters) + rng.choice(letters) + rng.choice(letters) for _ in range(n)]


def test_odd_rows(spark):
    rng = random.Random(1)
    long = " ".join(text(rng, 30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c"), (7, long), (8, long + " end"), (9, long), (None, "a b"), (None, "x y z"), (11, "q r s t u"), (11, "q r s t v"), (12, "Q R S T U"), (13, "q r s t u v w x")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0]) == []


def test_groups_of_altered_copies(spark):
    """Copies of one text with one to nine words changed, put in or left out: many are unlike each other, some are alike in what they changed."""
    rng = random.Random(2)
    rows = [(i, " ".join(text(rng, rng.randrange(1, 60)))) for i in range(1000, 1060)]
    base, d = text(rng, 150), 0
    drifts = [base]
    for step in range(3):  # texts that share changes and pass out of reach of the base
        drifts.append([w if rng.random() > 0.04 else "zz" + w for w in drifts[-1]])
    for _ in range(250):
        w = list(rng.choice(drifts))
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1, 2])] = text(rng, rng.choice([0, 1, 1]))
        rows.append((d := d + 1, " ".join(w)))
    rng.shuffle(rows)
    want = brute(rows)
    assert len({c for _, _, c in want}) > 65 and found(spark, rows) == want


@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.sampled_from([60, 80, 85]))
def test_linked_sets_share_a_first_deviation(x, y, c, percent):
    x, y, c = (np.array(sorted(v), np.uint64) for v in (x, y, c))
    linked = lambda s, t: 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))
    lx, tx, sx, dx = minhash.deviation(x, c, percent)
    ly, ty, sy, dy = minhash.deviation(y, c, percent)
    assert lx == linked(x, c) and ly == linked(y, c)
    if linked(x, y) and not ly and not np.array_equal(x, y):
        common = [(i, ty.tolist().index(t)) for i, t in enumerate(tx.tolist()) if t in ty.tolist()]
        full, q = 100 + percent, 100 - percent
        assert any(min(dx - i, dy - j) * 2 * full >= (dx + dy) * full - q * (len(x) + len(y)) and (lx or (i < sx and j < sy)) for i, j in common)


def test_bins_agree_by_similarity():
    rng = np.random.default_rng(3)
    for n in (6, 40, 900):
        agree = []
        for _ in range(60):
            s = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            t = np.append(s[: -max(1, n // 10)], rng.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64))
            v = minhash.densified(*minhash.one_permutation([np.sort(s), np.sort(t)]))
            agree.append((v[0] == v[1]).mean())
        k = n - max(1, n // 10)
        assert abs(np.mean(agree) - k / (2 * n - k)) < 0.05
    empty = minhash.band_keys([np.zeros(0, np.uint64)])
    assert empty.shape == (1, minhash.BANDS)
