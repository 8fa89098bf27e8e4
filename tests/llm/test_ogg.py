import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


@given(st.binary(max_size=400))
def test_crc(data):
    assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 4095, 4096, 4097, 65025, 65280, 522240, 1_000_000])
def test_round_trip(n):
    payload = ogg.padded(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and len(payload) >= 64
    got, told = ogg.decode(ogg.encode(payload))
    assert got == payload and sum(told["samples"]) == len(payload)


@settings(max_examples=60)
@given(st.integers(0, 10**6), st.integers(0, 7))
def test_damage_is_found(at, bit):
    good = ogg.encode(ogg.padded(b"some text that is stored" * 700))
    bad = bytearray(good)
    bad[at % len(good)] ^= 1 << bit
    with pytest.raises(ogg.Damaged):
        ogg.decode(bytes(bad))


def test_a_missing_page_is_found():
    whole = ogg.encode(ogg.padded(b"x" * 400_000))
    starts = [i for i in range(len(whole)) if whole[i : i + 4] == b"OggS"]
    with pytest.raises(ogg.Damaged):
        ogg.decode(whole[: starts[3]] + whole[starts[4] :])
    with pytest.raises(ogg.Damaged):
        ogg.decode(whole[:-3])


def test_granules_and_streams():
    streams = ogg.demux(ogg.encode(bytes(5 * ogg.PACKET)))
    assert [len(p) for p in streams.values()] == [4, 3]
    assert [end for _, end in streams[1]][1:] == [ogg.PACKET, 2 * ogg.PACKET, 3 * ogg.PACKET]


def test_frame(spark):
    rows = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (None, "é" * 50_000)]
    got = {r.doc_id: r for r in ogg.media_column(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1:] == got[2][1:] and got[3][1:] == got[4][1:] and bytes(got[1].payload) == b"abc" + bytes(61)
    assert got[None].n_bytes == 100_000 and ogg.decode(bytes(got[None].media))[0] == bytes(got[None].payload)
    assert ogg.media_column(spark.createDataFrame([], "doc_id long, text string, media binary")).count() == 0


def test_query_columns(spark, tmp_path):
    """The query's columns against hashlib and zlib, for odd texts too."""
    import hashlib
    import zlib

    from folioflow.llm.queries import op9_ogg_media

    texts = [None, "", "a", "x" * 63, "y" * 64, "z" * 65, "é" * 100, "long " * 200_000, "a", "  \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op9_ogg_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = ogg.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and ogg.decode(media)[0] == payload
        x = [b - 128 for b in payload]
        assert f"mean={sum(x) * 1000 // len(x)};ms2={sum(v * v for v in x) // len(x)};zc={sum((p < 0) != (q < 0) for p, q in zip(x, x[1:]))}" in r.feature
    assert rows[2][1:] == rows[8][1:] and rows[0][1:] == rows[1][1:]
