"""Queries over documents with empty texts and nulls, against their SQL."""

from pathlib import Path

import pytest
from compare import duck_rows, spark_rows

from folioflow.plans import search_queries, text_queries  # noqa: F401
from folioflow.plans.registry import ORACLES, QUERIES
from folioflow.session import TABLES

TEXTS = ["", None, " ", " lead", "a/", "a\\", "a/.", "..", "x/y.z", "w\n/v", "é" * 50, "é" * 51, "p/" + "🦆" * 230, "tail \n", ".pdf", "a|b c", "|"]


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    into = tmp_path_factory.mktemp("odd")
    kinds = [(lang, source) for lang in ("en", "", None) for source in ("site-1", "a_1", "", None)]
    rows = [(len(TEXTS) * k + i, t, lang, source) for k, (lang, source) in enumerate(kinds) for i, t in enumerate(TEXTS)]
    rows += [(9000, None, "en", "nulls"), (9001, "", "en", "blank"), (None, "no id", "en", "site-1"), (None, "", "zz", "a_1"), (-5, "", "zz", "a_1")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars")
    made.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(into / "documents.parquet", index=False)
    for t in set(TABLES) - {"documents"}:
        (into / f"{t}.parquet").symlink_to(Path(sf_dir) / f"{t}.parquet")
    return str(into)


@pytest.mark.parametrize("name", ["paper_id_gen", "paper_sections", "source_cards"])
def test_odd_documents(spark, odd_dir, name):
    assert spark_rows(QUERIES[name](spark, odd_dir)) == duck_rows(ORACLES[name], odd_dir)
