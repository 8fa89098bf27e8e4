import hashlib
import random
import re

import numpy as np

from folioflow.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            x = words(body)
            n = min(len(x), window)
            wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else []:
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(item)
        ids = ",".join(sorted(str(i) for i in found - {None}))
        out.append((doc_id, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(12)), (None, text(12)), (7, None), (8, "!!")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(30)]
    docs += [(100 + i, text(5) + "... " + (body or "").upper() + ". " + text(4)) for i, (_, body) in enumerate(items)]
    return docs + [(1, None), (2, ""), (2, ""), (None, "w1 w2")], items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = made(seed)
        if seed:
            items = [x for x in items if len(words(x[1])) >= 10]
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = sorted((tuple(r) for r in decontam.report(d, b).collect()), key=repr)
        assert got == brute(docs, items)
        blocks = decontam.scan(d, b, max_words=40).select("doc_id", "n_words", "hits", "items")
        one = decontam.scan(d, b).select("doc_id", "n_words", "hits", "items")
        assert sorted(map(repr, blocks.collect())) == sorted(map(repr, one.collect()))


def test_automaton_knows_every_substring():
    rng = random.Random(5)
    items = [(i, np.array([rng.randrange(1, 4) for _ in range(20)], np.uint64)) for i in range(5)]
    a = decontam.Automaton(items, window=4)
    grams = {tuple(w[i : i + n].tolist()) for _, w in items for n in range(1, 8) for i in range(20 - n + 1)}
    for _ in range(300):
        s = [rng.randrange(1, 4) for _ in range(7)]
        state = size = 0
        for k, c in enumerate(s, 1):
            state, size = a.step(state, size, c)
            longest = max([n for n in range(1, k + 1) if tuple(s[k - n : k]) in grams], default=0)
            assert size == longest


def test_spans_go(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it, {passage.upper()}! And after it is much more that stays here.", 9), (2, passage, 3), (3, "Clean  text.\n", 13), (4, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").withColumnRenamed("n_chars", "n_chars")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.decontaminate(d, b).collect()}
    want = "Before it, ! And after it is much more that stays here."
    assert got == {1: (want, len(want)), 3: ("Clean  text.\n", 13), 4: (None, None)}


def test_clashing_columns_stay(spark):
    d = spark.createDataFrame([(1, "a b", "mine", 5)], "doc_id long, text string, items string, n_words int")
    got = decontam.decontaminate(d, spark.createDataFrame([(1, "b")], "item_id long, text string"), 1.0)
    assert got.columns == d.columns and got.first() == (1, "a ", "mine", 5)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(d, b).first().n_words == 2 and decontam.report(d.limit(0), b).count() == 0
