import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import common, kernels


def test_fetched_is_a_semi_join(spark):
    docs = spark.range(3000).select((F.col("id") * 7919).alias("doc_id"), F.lit("x").alias("text"))
    need = docs.where("doc_id % 11 = 0").select("doc_id").union(spark.range(5).select((F.col("id") - 9).alias("doc_id")))
    got = common.fetched(docs, need)
    assert sorted(r.doc_id for r in got.collect()) == [k * 7919 for k in range(3000) if k * 7919 % 11 == 0]
    assert common.fetched(docs, need.limit(0)).count() == 0


def test_ranks_are_gapless_in_hot_groups(spark):
    rows = [(0, i, i % 3) for i in range(2000)] + [(k, 0, 0) for k in range(1, 9)] + [(0, 5, 2)] * 4
    df = spark.createDataFrame(rows, "g int, a int, b int")
    got = common.ranked(df, ["g"], ["a", "b"], "r", salts=16).toPandas()
    for _, g in got.groupby("g"):
        assert sorted(g.r) == list(range(len(g)))
    again = common.ranked(df.repartition(5), ["g"], ["a", "b"], "r", salts=16).toPandas()
    key = ["g", "a", "b", "r"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_tables_go(spark):
    scratch = common.Scratch()
    first = common.written(spark.range(5).toDF("n"), "first")
    last = scratch.settled(first.where("n > 2"), "last")
    assert not os.path.exists(first._table.removeprefix("file:")) and last.count() == 2
    common.dropped(last)
    assert not os.path.exists(last._table.removeprefix("file:"))


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t中.X", max_size=30)), max_size=12)


@given(TEXTS)
def test_words_are_pythons(texts):
    data, off = kernels.buffers(pa.array(texts, pa.string()))
    starts, ends, woff = kernels.spans(data, off, kernels.NOT_SPACE)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        assert [raw[a:b] for a, b in zip(starts[woff[k] : woff[k + 1]], ends[woff[k] : woff[k + 1]], strict=True)] == (t or "").encode().split()


@given(TEXTS, st.integers(1, 7))
def test_hashes_do_not_depend_on_place(texts, k):
    data, off = kernels.buffers(pa.array(texts, pa.string()))
    wh, woff = kernels.words(data, off, kernels.NOT_SPACE)
    sh = kernels.shingles(wh, k)
    for i in range(len(texts)):
        d, o = kernels.buffers(pa.array(texts[i : i + 1], pa.string()))
        own, _ = kernels.words(d, o, kernels.NOT_SPACE)
        assert (own == wh[woff[i] : woff[i + 1]]).all()
        n = len(own) - k + 1
        if n > 0:
            assert (kernels.shingles(own, k)[:n] == sh[woff[i] : woff[i] + n]).all()


def thue_morse(n):
    """A word of n letters and its complement: a polynomial modulo 2^64 cannot tell them apart."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 64, 1024, 4096, 4099])
def test_structured_words_have_their_own_hashes(n):
    one, other = thue_morse(n)
    data, off = kernels.buffers(pa.array([one, other, one + "c", one]))
    h = kernels.span_hash(data, off[:-1], off[1:])
    assert h[0] == h[3] and len(set(h.tolist())) == 3


@given(st.lists(st.binary(max_size=40), max_size=20))
def test_span_hashes_tell_bytes(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    h = kernels.span_hash(data, off[:-1], off[1:]).tolist()
    assert all((a == b) == (p == q) for a, p in zip(h, parts, strict=True) for b, q in zip(h, parts, strict=True))


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_chunks_are_whole_texts(limit):
    batch = pa.record_batch([pa.array(["ab", None, "", "c" * 50, "dé"])], names=["text"])
    got = [data[a:b].tobytes().decode() for _, data, off in kernels.chunks([batch.slice(1), batch.slice(0, 0)], "text", limit) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == ["", "", "c" * 50, "dé"]
    assert np.array_equal(kernels.mix(np.array([1], np.uint64)), kernels.mix(np.array([1], np.uint64)))


def test_scratch_keeps_the_tables_of_other_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as other:
        scratch = common.Scratch()
        theirs = other.submit(common.written, spark.range(3).toDF("n"), "theirs").result()
        ours = common.written(spark.range(2).toDF("n"), "ours")
        out = scratch.settled(ours.selectExpr("n + 1 AS n"), "out")
        assert theirs.count() == 3 and sorted(r.n for r in out.collect()) == [1, 2]
        with pytest.raises(Exception, match="(?i)not exist|cannot be found|not found"):
            ours.count()
        other.submit(common.dropped, theirs).result()
        common.dropped(out)
