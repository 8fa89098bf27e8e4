import sys
from pathlib import Path

import pytest
from compare import duck_rows, spark_rows

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from folioflow.llm.oracles import oracle_sql  # noqa: E402
from folioflow.llm.queries import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    if name in oracle_sql():
        assert spark_rows(df) == duck_rows(oracle_sql()[name], sf_dir)
    elif not name.startswith("op5"):
        table = "pages" if name.startswith("op1_") else "documents"
        ids = "page_id" if table == "pages" else "doc_id"
        want = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(ids).distinct().count()
        assert df.select(ids).distinct().count() == want
    else:
        assert set(df.columns) >= {"doc_id", "other_id"}


def test_thirteen_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, first = docs.columns, docs
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    for _, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert 0 < docs.count() < first.count()
    toxic = first.join(labels.where("toxic = 1"), "doc_id").count()
    assert docs.join(labels.where("toxic = 1"), "doc_id").count() < 0.3 * toxic
    packed = c.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns: clean rows go through every stage as they came; rows without words go only where nothing of a text is left."""
    import random

    import corpus_pipeline as c
    from pyspark.sql import functions as F

    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    lone, long, copied, passage, item = text(40), text(60_000), text(80), text(70), text(30)
    rows = [
        (1, lone, "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0), (4, "  ", None, "s", 2), (None, text(30), "en", "s", 5),
        (5, long, "de", "s", None), (6, copied, "en", "s", 7), (7, copied, "en", "s", 7), (8, copied + " end", "en", "s", 8), (9, f"{text(60)} {passage}", "en", "s", 9), (10, f"{passage} {text(60)}", "en", "s", 10),
        (11, f"{text(90)} {item} {text(90)}", "en", "s", 11), (12, item, "en", "s", 12), (13, lone[:20], "fr", "s", 13), (13, lone[:20], "fr", "s", 13),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ("held_out", "score", "n", "cls", "key", "start", "end", "_spans", "_maybe", "_m", "_key", "hits", "items", "n_words", "id", "label")
    docs = spark.createDataFrame(rows, columns).select("*", *(F.lit("own").alias(x) for x in clash))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = {}
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == [*(x.split()[0] for x in columns.split(", ")), *clash]
        assert all(r[x] == "own" for r in docs.collect() for x in clash)
        kept[name] = sorted((r.doc_id or 0) for r in docs.collect())
    everyone = sorted(r[0] or 0 for r in rows)
    assert kept["toxicity"] == everyone
    assert kept["near_duplicates"] == sorted(x for x in set(everyone) if x not in (7, 8))
    assert kept["repeated_passages"] == kept["near_duplicates"]
    assert kept["decontamination"] == [x for x in kept["near_duplicates"] if x != 12]
    left = {r.doc_id: r for r in docs.collect()}
    for d, t, lang, source, n in rows:
        if d in (1, 2, 3, 4, None, 5, 6, 9, 13):
            assert (left[d].text, left[d].lang, left[d].source, left[d].n_chars) == (t, lang, source, n)
    assert passage not in left[10].text and len(left[10].text.split()) == 60 and left[10].n_chars == len(left[10].text)
    assert item not in left[11].text and len(left[11].text.split()) == 180
    packed = c.run(spark, folder).collect()
    assert sorted({r.doc_id or 0 for r in packed}) == kept["decontamination"]
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) and b[1] + b[2] <= 2048 for a, b in zip(places, places[1:], strict=False))


def test_pipeline_on_empty_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline as c

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
