import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm import collocations as c


def brute(rows, least, top=2000):
    counts, totals = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        low = (t or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    wanted = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in wanted.items():
        if any(x == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (x, v), b in wanted.items()):
            continue
        cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], totals[lang]))
    out.sort()
    ranks, told = Counter(), []
    for lang, score, a, phrase, left, right, n in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            told.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return sorted(told)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({x: F.lit(1) for x in ("piece", "times", "phrase", "f", "a", "n", "bucket")})
    return sorted(map(tuple, c.collocations(df, **more).collect()))


WORDS = "New york City of the é 中 e-mail x a.b In vitro".split(" ")


def made(n, seed):
    import random

    rng = random.Random(seed)
    seps = [" ", " ", " ", "\t", "  ", ". ", "\n", ",", " ! "]
    return [(rng.choice(["en", "de", "e\tn", None]), "".join(rng.choice(WORDS) + rng.choice(seps) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


def test_small_corpora(spark):
    rows = made(150, 1)
    rows += rows[:20] + [("en", None), (None, ""), ("de", " . , \n"), ("en", "same line of words here\n" * 40), ("und", "of the City"), ("en", "very long " * 20_000)]
    assert found(spark, rows, least=8) == brute(rows, 8)
    assert found(spark, rows, least=8, top=3) == brute(rows, 8, 3)
    assert found(spark, rows[:0]) == []


def test_small_maps_and_many_parts(spark, tmp_path):
    rows = made(100, 2)
    # a map that lets too many through drops none
    assert found(spark, rows, least=5, spill=str(tmp_path / "s"), map_bits=10, held_rows=50) == brute(rows, 5)
    assert not list((tmp_path / "s").glob("*"))


def test_a_spill_folder_must_be_mounted(spark, monkeypatch):
    monkeypatch.setattr(c, "shared_dir", lambda _: "hdfs://host/x")
    with pytest.raises(ValueError, match="mounted"):
        c.spill_dir(spark)


def test_pieces():
    import pyarrow as pa

    from folioflow.llm.kernels import buffers

    data, off = buffers(pa.array(["A  b\tC. d", None, "", "..", "x\ny", " e "]))
    body, at, text = c.cut(data, off)
    raw = body.tobytes().decode()
    assert [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == ["a b c", "d", "x", "y", "e"] and text.tolist() == [0, 0, 4, 4, 5]
