import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import graph, jaccard, passages
from folioflow.llm.kernels import buffers
from folioflow.llm.loads import HOT_BITS

LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(docs))


def edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    line, passage = "this common line is in very many of the texts here", text(70)
    out = []
    for size in (5, 6, 7, 9, 12, 20, 33, 36, 60, 150):
        base = text(size)
        out += [base, base.upper(), *(edited(rng, base, k % 3 + 1) for k in range(6))]
        out += [base + " " + text(max(1, size // k)) for k in (4, 5, 8)]
    family = text(90)
    out += [edited(rng, family, rng.randrange(1, 4)) for _ in range(60)]
    out += [text(60) + " " + line + " " + text(20) for _ in range(20)] + [text(40) + " " + passage for _ in range(20)]
    out += ["a b c d", "a b c d e", "b c d", "", None, "   ", "", "one"]
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_exact(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3 + seed)
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == components_of(docs)


@pytest.mark.parametrize(("rare", "common"), [(12, 12), (12, 30), (14, 10**6), (40, 60)])
def test_components_are_exact_with_common_tokens(spark, monkeypatch, rare, common):
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    real, seen = jaccard.order_of, []

    def order(loads, percent=80):
        out = real(loads, percent)
        at = np.random.default_rng(1).random(len(loads)) < 0.7
        out.level[at & (loads > 0)] = 1 + np.minimum(loads[at & (loads > 0)], 20)
        out.rare, out.common, out.salted = rare, common, 3
        seen.append(int((out.level > 0).sum()))
        return out

    monkeypatch.setattr(jaccard, "order_of", order)
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == components_of(docs)
    assert seen[0] > 500


def test_counts_are_summed_over_tasks(spark):
    docs = corpus(8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = collections.Counter()
    classes = {shingle_set(t) for _, t in docs}
    for parts in (1, 7):
        loads = jaccard.bucket_loads(jaccard.profile(df.repartition(parts)).where("slice is not null"))
        want[parts] = int(loads.sum())
    assert want[1] == sum(map(len, classes)) and want[7] >= want[1]


def test_lists_of_common_sentences_stay_in_proportion():
    """Texts of ten sentences out of sixty: any shingle is in a share of all texts, and few texts are alike. Four times the texts make about four times the pairs within lists."""
    rng = random.Random(3)
    pool = [" ".join(f"s{k}w{i}" for i in range(12)) for k in range(60)]
    texts = [" ".join(rng.sample(pool, 10)) for _ in range(12800)]
    pairs = []
    for n in (3200, 12800):
        found = jaccard.sets(*buffers(pa.array(texts[:n])))
        loads = np.zeros(1 << HOT_BITS, np.int64)
        for s in found:
            np.add.at(loads, jaccard.bucket(s), 1)
        order, keys = jaccard.order_of(loads), []
        for s in found:
            level = order.level[jaccard.bucket(s)]
            by = np.lexsort((s, level))
            keys += [k for k, _, _ in jaccard.posted(s[by], level[by], order)]
        size = np.unique(np.concatenate(keys), return_counts=True)[1]
        pairs.append((size * (size - 1) // 2).sum())
    assert pairs[1] < 5 * pairs[0] < 5 * 200 * 3200, pairs


def test_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "other words are in this one here"), (2, "A b c d e f g"), (2, "A b c d e f g")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    extra = df.selectExpr("doc_id", "text", "1 as n", "2 as cls", "3 as component_id", "4 as _key", "5 as id")
    kept = jaccard.one_of_each(extra)
    assert kept.columns == extra.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f g"), (1, "other words are in this one here")]
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_null_ids_and_odd_texts(spark):
    rng = random.Random(11)
    base, lone = " ".join(f"w{rng.randrange(900)}" for _ in range(80)), " ".join(f"v{rng.randrange(900)}" for _ in range(40))
    long = " ".join(f"u{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(None, base), (3, base + " end"), (None, lone), (None, lone), (None, lone + " x"), (None, None), (None, None), (None, ""), (4, " "), (4, " "), (9, long), (8, long + " tail"), (5, base), (5, base), (5, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == {(None, 3): 1, (3, 3): 1, (5, 3): 3, (None, None): 6, (4, 4): 2, (9, 8): 1, (8, 8): 1}
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect())
    lones = {t: n for (d, t), n in kept.items() if d is None and t and t.startswith("v")}
    assert list(lones.values()) == [1]
    assert {k: n for k, n in kept.items() if k[1] not in lones} == {(3, base + " end"): 1, (None, None): 2, (None, ""): 1, (4, " "): 2, (8, long + " tail"): 1}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, len(a) // 2), rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
        assert jaccard.overlap_bound(jaccard.counts_of(a), jaccard.counts_of(b)) >= len(np.intersect1d(a, b))
    assert jaccard.prefix_length(10, 1) == 3 and jaccard.prefix_length(4, 1) == 1 and jaccard.boundary(0) == jaccard.LEAST_BORDER < jaccard.boundary(40) < jaccard.boundary(400)


def test_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_windows_are_tree_nodes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(0, 80, 5)
        off = np.concatenate([[0], np.cumsum(sizes)])
        h = rng.integers(0, 1 << 63, int(off[-1]), dtype=np.uint64)
        t = int(rng.integers(1, 12))
        want = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            for c in range(a, b):
                low = c
                while low > a and h[low - 1] > h[c]:
                    low -= 1
                high = c
                while high + 1 < b and h[high + 1] > h[c]:
                    high += 1
                if high - low + 1 >= t:
                    want.append((c, low, high))
        assert list(zip(*(x.tolist() for x in passages.windows(h, off, t)), strict=True)) == want


def passage_corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 60, 120, 400)]
    line, medium = "a line of seven words is common", text(35)
    out = [text(rng.randrange(0, 200)) for _ in range(20)]
    for p in shared:
        out += [f"{text(rng.randrange(0, 90))} {p} {text(rng.randrange(0, 90))}" for _ in range(4)]
    out += [f"{text(80)} {line} {text(80)}" for _ in range(15)] + [f"{text(30)} {medium} {text(30)}" for _ in range(12)]
    left, right = text(25), text(25)
    out += [f"{left} {medium} {text(30)}", f"{text(30)} {medium} {right}", f"{text(9)} {left} {medium} {text(3)}", f"{text(3)} {medium} {right} {text(9)}"]
    out += [out[25], out[25].upper(), "", None]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_repeats_are_found_and_nothing_else(spark, seed):
    docs = passage_corpus(seed)
    got = passages.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    covered = collections.defaultdict(list)
    text = {d: words(t) for d, t in docs}
    for r in got:
        assert r.other_id < r.doc_id and r.percent >= 80 and r.end - r.start >= 50
        assert len(set(text[r.doc_id][r.start : r.end]) & set(text[r.other_id][r.other_start : r.other_end])) > 30
        covered[r.doc_id].append((r.start, r.end))
    first, equal = {}, {}
    for d, t in docs:
        w = text[d]
        if t in equal:
            assert d in covered or len(w) < 50
            continue
        equal[t] = d
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                assert any(a <= i and i + 50 <= b for a, b in covered[d]), (d, i)


def test_near_passages():
    rng = random.Random(3)
    w = [f"w{i}" for i in range(300)]
    x = w[:100] + [f"x{i}" for i in range(50)]
    y = [f"y{i}" for i in range(40)] + w[:45] + ["edit"] + w[46:100]
    h = lambda v: np.array([hash(t) & 0xFFFFFFFFFFFFFFFF for t in v], np.uint64)
    assert rng and [p[:4] for p in passages.common_passages(h(x), passages.Text(h(y)))] == [(0, 100, 40, 140)]
    assert passages.common_passages(h(w[:49]), passages.Text(h(w[:49]))) == [] and passages.common_passages(h(w), passages.Text(h(x[100:]))) == []


def test_near_partners_behind_other_heads(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    heads, pairs = [], []
    for _ in range(12):
        p = text(50)
        heads += [text(45) + p[i : i + 5] + text(45) for i in range(46) for _ in range(2)]
        pairs += [text(30) + p + text(30), text(30) + p[:24] + ["edit"] + p[25:] + text(30)]
    docs = [(i, " ".join(w)) for i, w in enumerate(heads + pairs)]
    got = {(r.other_id, r.doc_id) for r in passages.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    n = len(heads)
    missed = [i for i in range(0, len(pairs), 2) if (n + i, n + i + 1) not in got]
    assert missed == []


def test_recall_of_near_passages(spark):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for i in range(400):
        p = text(rng.randrange(50, 61))
        at = len(p) // 2
        docs += [(2 * i, text(30) + p + text(30)), (2 * i + 1, text(30) + p[:at] + ["edit"] + p[at + 1 :] + text(30))]
    h = lambda v: np.array([hash(t) & 0xFFFFFFFFFFFFFFFF for t in v], np.uint64)
    want = {(a[0], b[0]) for a, b in zip(docs[::2], docs[1::2], strict=True) if passages.common_passages(h(b[1]), passages.Text(h(a[1])))}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    got = {(r.other_id, r.doc_id) for r in passages.repeats(frame.repartition(4)).collect()}
    assert len(want) == 400 and got <= want and len(got) >= 0.99 * len(want), len(got)


def test_cuts(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p = text(60)
    a, b, c = f"{text(20)}\n{p}\n{text(20)}", f"Other start. {p} Other end.", text(90)
    df = spark.createDataFrame([(1, a, 5, 0), (2, b, 6, 0), (3, c, 7, 0), (4, p, 8, 0), (5, None, 9, 0)], "doc_id long, text string, n_chars long, start int")
    got = {r.doc_id: (r.text, r.n_chars) for r in passages.cut_repeats(df).collect()}
    assert got == {1: (a, 5), 2: ("Other start.  Other end.", 24), 3: (c, 7), 5: (None, 9)}
    assert passages.repeats(df.limit(0)).count() == 0 and passages.cut_repeats(df.limit(0)).columns == df.columns
