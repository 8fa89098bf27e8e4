import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.sources import connectors, files, sinks


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = archive({"a.md": "other", "x/full.md": "# T", "content_list.json": json.dumps([{"page_idx": 0}, {"page_idx": 4}]), "images/i.png": b"x"})
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.archives(files.scan(spark, str(tmp_path), "*.zip")).collect()}
    assert got["good.zip"].markdown == "# T" and got["good.zip"].page_count == 5 and got["good.zip"].images == ["images/i.png"]
    assert got["bad.zip"].error and got["bad.zip"].markdown is None


def test_pdf(spark, tmp_path):
    pdf = b"%PDF-1.4\n1 0 obj <</Title (A Study) /Author (Ann) /CreationDate (D:20210101)>> endobj 2 0 obj <</Type /Pages /Kids [] /Count 7>> endobj 3 0 obj <</FT /Tx /T (name) /V (v)>> endobj"
    (tmp_path / "0a1b2c3d_x.pdf").write_bytes(pdf)
    (tmp_path / "0a1b2c3d_y.pdf").write_bytes(b"nothing")
    rows = files.scan(spark, str(tmp_path))
    got = {r.path[-5]: r for r in files.pdf_metadata(rows).collect()}
    assert (got["x"].title, got["x"].author, got["x"].year, got["x"].page_count) == ("A Study", "Ann", 2021, 7)
    assert [(f.name, f.kind, f.value) for f in got["x"].fields] == [("name", "text", "v")]
    assert got["y"].title == "y" and got["y"].error
    known = files.uploads(rows).where("path like '%x.pdf'")
    assert sorted(str(r.rejected) for r in files.uploads(rows, known).collect()) == ["None", "duplicate"]
    assert files.scan(spark, str(tmp_path), limit=1).count() == 1


def test_stores(spark, tmp_path):
    lines = spark.createDataFrame([("# c",), ("",), ("A_B = 'x y'",), ("bad line",), ("K=v",)], "value string")
    assert sorted(tuple(r) for r in files.env_pairs(lines).collect()) == [("A_B", "x y"), ("K", "v")]
    assert sinks.env_text("# c\nK=1\nX=2\n", {"K": "9", "N": "3"}) == "# c\nK=9\nX=2\nN=3\n"
    (tmp_path / "t.json").write_text('{"paper_id": "a", "deleted_at": 1.5}\nbroken\n')
    assert [r.paper_id for r in files.tombstone_store(spark, str(tmp_path / "t.json")).collect()] == ["a"]
    blocks = spark.createDataFrame([('[{"type":"text","page_idx":1}]',)], "c string").select(files.shift_pages(files.content_blocks("c"), F.lit(180)).alias("b")).first()
    assert blocks.b[0].page_idx == 181


def test_connectors(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise connectors.Busy(0)
        return "ok"

    assert connectors.tried(flaky, sleep=lambda s: None) == "ok"
    with pytest.raises(ValueError):
        connectors.tried(lambda: int("x"), tries=2, sleep=lambda s: None)
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "x" * 20000)], "id int, content string")
    got = {r.id: r for r in connectors.embedded(rows, connectors.HashEmbedder(8)).collect()}
    assert len(got[1].embedding) == 8 and got[2].embedding is None and got[3].too_long and got[3].embedding is None
    done = connectors.parsed(spark.createDataFrame([("p", bytearray(b"text"), 200)], "path string, content binary, page_count int"), connectors.TextParser()).first()
    assert (done.markdown, done.parts, done.failed) == ("text\n\ntext", 2, 0)
    seen = connectors.described(spark.createDataFrame([("p", bytearray(b"x"), "formula_like")], "path string, content binary, route string")).first()
    assert (seen.description, seen.status) == ("公式图片", "degraded")
    assert connectors.first_answer([connectors.EchoModel()], [{"content": "hi"}]) == "hi [1]"


def test_tools():
    tools = connectors.Tools()
    tools.register("double", lambda a: a["x"] * 2)
    told = iter([{"name": "double", "args": {"x": 2}}, {"name": "nope"}, "done"])
    answer, results = tools.run(lambda r: next(told))
    assert answer == "done" and results[0]["result"] == 4 and "error" in results[1]


def test_turns_go_on_without_a_failing_channel(spark):
    def bad(df):
        raise OSError("full")

    seen = []
    told = sinks.persist_turns(spark.range(2), {"a": bad, "b": lambda df: seen.append(df.count())})
    assert told["b"] == "ok" and told["a"].startswith("degraded") and seen == [2]


def test_structured(spark):
    chunks = spark.createDataFrame([("p", 0, "c", "t", False, [("a0", 1, 0, 5)])], "paper_id string, chunk_index int, content string, section_title string, has_image boolean, anchors array<struct<anchor_id:string,page:int,char_start:int,char_end:int>>")
    visuals = spark.createDataFrame([("p", "i.png")], "paper_id string, path string")
    got = sinks.structured(chunks, visuals).first()
    assert (got.stats.chunk_count, got.stats.anchor_count, got.stats.visual_block_count) == (1, 1, 1)
    assert sinks.index_rows(chunks).first().page == 1
