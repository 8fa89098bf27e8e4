from folioflow.plans import flows
from folioflow.sources import connectors


def test_cleaning(spark):
    noisy = "·社会学理论与实践研究·\n# 标题\n### 一 小 节\n文献标志码：A\nA 正 文 内容。  \n\n\n\n12\nhttps://a.b /c\n| a | b |\n| 1 | 2 |"
    df = spark.createDataFrame([(1, noisy), (2, None), (3, "")], "id int, text string")
    got = {r.id: r for r in flows.cleaned(df).collect()}
    assert got[1].text == "# 标题\n## 一小节\nA 正文内容。\n\nhttps://a.b/c\nab12" and got[2].text is None and got[3].text == ""
    assert got[1].reduction_ratio > 0
    again = flows.cleaned(spark.createDataFrame([(1, got[1].text)], "id int, text string")).first()
    assert again.text == got[1].text
    generic = flows.cleaned(spark.createDataFrame([(1, "ＡＢ\x00１\n" + "x" * 80)], "id int, text string"), paper=False).first()
    assert generic.text == "AB1\nxxx" or generic.text == "AB1xxx"


def test_from_files_to_answers(spark, tmp_path):
    docs = {"deep.pdf": "# Deep learning\nNeural networks learn features. They need data.", "cook.pdf": "# Cooking\nBoil the water. Add salt and rice.", "gone.pdf": "# Gone\nNeural networks were here."}
    files = spark.createDataFrame([(f"x/{n}", bytearray(t.encode()), 1) for n, t in docs.items()], "path string, content binary, page_count int")
    out = str(tmp_path / "index")
    report = flows.ingest(files, connectors.TextParser(), connectors.HashEmbedder(32), out).collect()
    assert {r.paper_id: r.status for r in report} == {"deep": "ok", "cook": "ok", "gone": "ok"}
    questions = spark.createDataFrame([(1, "How do Neural networks learn?"), (2, "salt and rice")], "query_id int, text string")
    gone = spark.createDataFrame([("gone",)], "paper_id string")
    found = flows.search(spark, out, questions, connectors.HashEmbedder(32), gone)
    best = {r.query_id: r for r in found.where("rank = 1").collect()}
    assert (best[1].paper_id, best[2].paper_id) == ("deep", "cook")
    assert "gone" not in {r.paper_id for r in found.collect()}
    told = {r.query_id: r for r in flows.answered(found, questions, connectors.EchoModel()).collect()}
    assert told[1].source_ids[0] == "src_deep_0" and told[1].blocks[0]["type"] in ("paragraph", "heading")
    flows.ingest(files.where("path like '%cook%'"), connectors.TextParser(), connectors.HashEmbedder(32), out)
    assert spark.read.parquet(out + "/vectors").select("paper_id").distinct().count() == 3


def test_a_failing_leg_is_an_empty_one(spark, tmp_path):
    out = str(tmp_path / "index")
    files = spark.createDataFrame([("cook.pdf", bytearray(b"# Soup\nBoil onions. Add salt."), 1), ("math.pdf", bytearray(b"# Sums\nAdd two numbers."), 1)], "path string, content binary, page_count int")
    flows.ingest(files, connectors.TextParser(), connectors.HashEmbedder(32), out).collect()
    questions = spark.createDataFrame([(1, "onions")], "query_id int, text string")

    class Down:
        window = 8000

        def embed(self, texts):
            raise ConnectionError("no model")

    failed: dict = {}
    found = flows.search(spark, out, questions, Down(), failed=failed).collect()
    assert [r.paper_id for r in found] == ["cook"] and list(failed) == ["dense"]
    import shutil

    shutil.rmtree(f"{out}/postings")
    failed = {}
    assert flows.search(spark, out, questions, connectors.HashEmbedder(32), failed=failed).count() == 2 and not failed  # an index without parts finds nothing
