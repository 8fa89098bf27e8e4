import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import langid, learn, quality, toxicity
from folioflow.llm.kernels import buffers

LANGS = {"aa": ["tion", "ing", "the", "er"], "bb": ["ung", "keit", "sch", "über"], "cc": ["ción", "ado", "que", "ez"]}


def word(rng, lang):
    return "".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4)))


def text(rng, lang, n):
    return " ".join(word(rng, lang) for _ in range(n))


def corpus(seed, n=600):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        w = text(rng, lang, rng.randrange(20, 120)).split()
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "awful", "nasty"]))
        if not good:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), lang if i % 11 else None, "s"))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1)
    odd = [(9000, None, None, None), (9001, "", "aa", None), (9002, "12 !!", None, "x"), (None, text(random.Random(2), "aa", 30), "aa", "s"), (0, docs[0][1], docs[0][2], "s"), (9003, "nasty " * 30000, "aa", "s")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string")
    return d, spark.createDataFrame(labels + [(5, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def accuracy(df, labels, label):
    rows = df.where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id").select((F.col("predicted") == F.col(label)).cast("int").alias("ok")).collect()
    assert len(rows) > 60
    return np.mean([r.ok for r in rows])


def test_toxicity(spark, tables):
    docs, labels = tables
    got = toxicity.classify(docs.withColumn("score", F.lit("clash")), labels)
    assert accuracy(got, labels, "toxic") > 0.93
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[9000].score == rows[9001].score and rows[9003].predicted == 1
    shuffled = {r.doc_id: r.score for r in toxicity.classify(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z")), labels).collect()}
    assert max(abs(shuffled[k] - rows[k].score) for k in rows) < 1e-9
    none = toxicity.classify(docs, labels.limit(0)).select("predicted").distinct().collect()
    assert len(none) == 1 and toxicity.classify(docs.limit(0), labels).count() == 0


def test_thresholds():
    s, y = np.array([0.1] * 40 + [0.35] * 40), np.array([0] * 40 + [1] * 40)
    assert toxicity.thresholds(s, y, ["a"] * 80)["a"] <= 0.35 and toxicity.thresholds(s[:10], y[:10], ["b"] * 10) == {"b": 0.5}


def test_quality(spark, tables):
    docs, labels = tables
    got = quality.assess(docs, labels)
    assert accuracy(got, labels, "quality") > 0.95
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[9000].score == rows[9001].score and got.count() == docs.count()
    assert quality.assess(docs, labels.limit(0)).count() == docs.count() and quality.assess(docs.limit(0), labels).count() == 0


def test_attention_gradients():
    rng = random.Random(1)
    texts = pa.array([text(rng, "aa", 100) if k % 2 else text(rng, "aa", 100).upper() for k in range(40)])
    m = quality.train(texts, [k % 2 for k in range(40)], 0.5, epochs=150)
    s = m.score(*buffers(texts))
    assert (s[1::2] > 0.8).all() and (s[::2] < 0.2).all()
    x, poff = quality.passages(*buffers(texts))
    got = m.forward((x - m.mean) / m.scale, poff)
    assert np.allclose(np.add.reduceat(got["a"], poff[:-1]), 1, atol=1e-5)


def test_language(spark, tables):
    docs, _ = tables
    got = langid.identify(docs)
    rows = got.join(docs.select("doc_id", "lang").where("lang is not null and doc_id < 9000").distinct(), "doc_id").where("held_out").collect()
    assert len(rows) > 60 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    odd = {r.doc_id: r for r in got.where("doc_id >= 9000").collect()}
    assert [odd[k].lang_pred for k in (9000, 9001, 9002)] == ["und"] * 3 and odd[9000].score == 0 and odd[9003].lang_pred in LANGS
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"} and langid.identify(docs.limit(0)).count() == 0


def test_only_the_other_folds_are_learned_from(spark, tables):
    docs, labels = tables
    texts, _ = learn.labelled_sample(docs, labels, "toxic", {1: 0.5, 0: 0.5})
    held = {r.text for r in docs.where(learn.held_out()).collect()}
    assert len(texts) > 100 and not held & set(texts.to_pylist())
    few, _ = learn.labelled_sample(docs, labels, "toxic", {1: 0.5, 0: 0.5}, max_rows=40)
    assert 10 < len(few) < 90


def test_subwords_stay_in_their_text():
    a, b = "Éàb thing", "xyz"
    data, off = buffers(pa.array([a, "", b]))
    both = langid.subwords(data, off)
    da, oa = buffers(pa.array([a]))
    assert (both[:, : off[1]] == langid.subwords(da, oa)).all()
    db, ob = buffers(pa.array([b]))
    assert (both[:, off[2] :] == langid.subwords(db, ob)).all()


def test_every_label_is_drawn(spark, monkeypatch):
    rows = [(i, f"text {i} " + "x" * 50, f"l{i % 80:02d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(set(learn.column_sample(docs, "lang", 2000)[1])) == 80
    monkeypatch.setattr(learn, "MAX_BYTES", 20_000)
    late = spark.createDataFrame([(i, f"text {i} " + "x" * 50, "high" if i >= 3500 else "low") for i in range(4000)], "doc_id long, text string, lang string")
    texts, labels = learn.column_sample(late, "lang", 4000)
    assert set(labels) == {"low", "high"} and sum(len(t) for t in texts.to_pylist()) <= 20_000


def test_samples_are_bounded_at_any_row_count(spark, monkeypatch):
    rows = spark.range(40_000).selectExpr("id AS doc_id", "'l' || id % 2 AS lang")
    whole = learn._drawn(rows, "lang", None, 400).count()
    monkeypatch.setattr(learn, "SCALE", 4)  # shares of one in two hundred, far below one in SCALE
    assert 300 < learn._drawn(rows, "lang", None, 400).count() < 500 and 300 < whole < 500
    assert learn._drawn(rows, "lang", None, 80_000).count() == 40_000


def test_a_hundred_languages(spark):
    """Each language has letters of its own; one of them has nine tenths of all rows."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        k = 0 if rng.random() < 0.9 else rng.randrange(100)
        letters = [chr(97 + k % 26) + chr(97 + k // 26), chr(97 + k // 26) + "z" + chr(97 + k % 26)]
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(30)), f"l{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, labels = learn.column_sample(docs, "lang", 6000)
    assert set(labels) == {r[2] for r in rows if learn_fold(r[0])}
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).where("held_out").collect()}
    rare = [(d, lang) for d, _, lang in rows if d in got and lang != "l00"]
    assert len(rare) > 80 and np.mean([got[d] == lang for d, lang in rare]) > 0.8


def learn_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def test_all_passages_of_a_long_text_are_learned_from(monkeypatch):
    rng = random.Random(3)
    texts = [text(rng, "aa", quality.PASSAGE * n) for n in (5000, 1, 7, 9000, 3, 40)]
    texts.append("")
    seen, forward = [], quality.Model.forward

    def counted(self, x, poff):
        seen.append((len(x), len(poff) - 1))
        return forward(self, x, poff)

    monkeypatch.setattr(quality.Model, "forward", counted)
    quality.train(pa.array(texts), [1, 0, 1, 0, 1, 0, 1], 0.5, epochs=3)
    assert sum(n for n, _ in seen) == 3 * 14051 and sum(k for _, k in seen) == 3 * 6
    assert all(n <= quality.AT_ONCE or k == 1 for n, k in seen)


def convolved(net, words_of):
    """The logits by the definition: every filter at every place of a text, the greatest response of each."""
    out = []
    for ids in words_of:
        if not ids.shape[1]:
            out.append(net.empty)
            continue
        e = sum(net.embed[c][ids[c]].astype(float) for c in range(3))
        z, tap = float(net.base), 0
        for k, width in enumerate(toxicity.WIDTHS):
            for lane in range(toxicity.FILTERS):
                columns = [(tap + j) * toxicity.FILTERS + lane for j in range(width)]
                places = [sum(e[i + j] @ net.filters[:, c].astype(float) for j, c in enumerate(columns)) for i in range(len(e) - width + 1)]
                f = k * toxicity.FILTERS + lane
                z += max(max(places, default=-np.inf) + float(net.bias[f]), 0) * float(net.out[f])
            tap += width
        out.append(z)
    return np.array(out)


def test_toxicity_equals_brute_force(spark, tables):
    docs, labels = tables
    net, language, cuts = toxicity.fitted(docs, labels)
    rows = [r for r in toxicity.classify(docs, labels).collect() if r.doc_id is None or r.doc_id != 9003][::7]
    texts = [r.text or "" for r in rows]
    ids = [toxicity.word_ids(*buffers(pa.array([t])))[0] for t in texts]
    want = learn.sigmoid(convolved(net, ids))
    assert np.allclose([r.score for r in rows], want, atol=1e-4)
    assert all(r.predicted == int(w >= 0.5) for r, w in zip(rows, want, strict=True) if abs(w - 0.5) > 1e-3)
    assert all(r.flagged == (r.score >= cuts.get(r.lang_told, 0.5)) for r in rows)


def test_every_labelled_row_is_learned_from(spark):
    """Words that tell the label are in two documents each, so that a network which leaves rows out does not know them."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(6000)]
    rows = [(i, f"some plain text {words[i // 2]} and more", "aa", i // 2 % 2) for i in range(12000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).where("not held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("toxic")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.93


def test_training_and_thresholds_take_all_rows(spark, tables, monkeypatch):
    docs, labels = tables
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    got = toxicity.classify(docs, labels)
    assert accuracy(got, labels, "toxic") > 0.93
    one, two = (toxicity.fitted(d, labels) for d in (docs, docs.repartition(3, "text")))
    assert (one[0].embed == two[0].embed).all() and one[0].base == two[0].base and (one[1].logits == two[1].logits).all() and one[2] == two[2]
    rows = learn.labelled_rows(docs, labels, "toxic", [0, 1])
    texts = [(r.text, r.label) for r in rows.collect()]
    known = {r.doc_id for r in labels.where("toxic is not null and doc_id is not null").collect()}
    want = docs.where(~learn.held_out() & F.col("text").isNotNull() & F.col("doc_id").isin(list(known))).count()
    assert len(texts) == want > 400
    counts = toxicity.bucket_counts(rows.repartition(5))
    for word in ("vile", "the", "ungsch"):
        at = toxicity.word_ids(*buffers(pa.array([word])))[0][0, 0]
        for label in range(2):
            assert counts[label, 0, at] == sum(y == label and at in toxicity.word_ids(*buffers(pa.array([t])))[0][0] for t, y in texts)
    sums = sum(np.bincount(langid.subwords(*buffers(pa.array([r.text]))).ravel(), minlength=langid.BUCKETS) for r in docs.where(~learn.held_out() & F.expr("lang = 'bb' and text is not null")).collect())
    n = sums[1:].astype(float)
    assert np.allclose(one[1].logits[1:, one[1].langs.index("bb")], np.log((n + 0.5) / (n.sum() + 0.5 * len(n))), atol=1e-4)


def test_quality_equals_brute_force(spark, tables):
    docs, labels = tables
    m = quality.fitted(docs, labels)
    rows = [r for r in quality.assess(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect() if r.doc_id != 9003][::5]
    for r in rows:
        x, _ = quality.passages(*buffers(pa.array([r.text or ""])))
        if not len(x):
            want = m.empty
        else:
            h = [np.tanh(row @ m.p["W"] + m.p["b"]) for row in (x - m.mean) / m.scale]
            a = np.array([(np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"])))) @ m.p["w"] for v in h], float)
            a = np.exp(a) / np.exp(a).sum()
            want = 1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, h, strict=True)) @ m.p["c"] + m.p["d"][0])))
        assert abs(r.score - want) < 1e-4 and (r.predicted == int(want >= 0.3) or abs(want - 0.3) < 1e-3)
    assert len(rows) > 100


def test_language_equals_brute_force(spark, tables):
    docs, _ = tables
    m = langid.train(*learn.column_sample(docs, "lang"))
    rows = [r for r in langid.identify(docs).join(docs.select("doc_id", "text"), "doc_id").collect() if r.doc_id < 9000][::5]
    for r in rows:
        sums, size = np.zeros(len(m.langs)), 0
        for bucket in langid.subwords(*buffers(pa.array([r.text]))).ravel().tolist():
            if bucket:
                sums, size = sums + m.logits[bucket].astype(float), size + 1
        z = np.exp((sums / max(1, size) + m.bias) / m.temperature)
        assert r.lang_pred == m.langs[int(z.argmax())] and abs(r.score - z.max() / z.sum()) < 1e-4 and r.accepted == (r.score >= m.reject)


def test_clashing_columns(spark, tables):
    docs, labels = tables
    extra = docs.select("*", *(F.lit("x").alias(c) for c in ("held_out", "score", "predicted", "label", "text_hash", "size", "letters")))
    for run in (lambda d: toxicity.classify(d, labels).select("doc_id", "score"), lambda d: quality.assess(d, labels).select("doc_id", "score"), lambda d: langid.identify(d).select("doc_id", "score")):
        one, two = ({(r.doc_id, round(r.score, 9)) for r in run(d).collect()} for d in (docs, extra))
        assert one == two
