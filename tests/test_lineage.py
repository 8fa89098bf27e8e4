from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.operators import lineage, segment


@given(st.text(alphabet="ab .!?;。；#\n\t\x85\u3000", max_size=60))
def test_places_cover_what_is_not_blank(text):
    places = lineage.sentence_places(text)
    ws = set("\t\n\x0b\x0c\r \x85\xa0\u3000")
    assert all(a < b for a, b, _ in places) and all(x[1] <= y[0] for x, y in zip(places, places[1:], strict=False))
    inside = {i for a, b, _ in places for i in range(a, b)}
    assert all(c in ws for i, c in enumerate(text) if i not in inside)
    assert all(level or (text[a] not in ws and text[b - 1] not in ws) for a, b, level in places)


TEXTS = [
    "# One\nFirst. Second! 三。四\n## Two\nSee ![a map](x/1.png) here. Also ![](2.png)\n### Three\ntext\n## Four\nend",
    "word " * 40 + ". " + "long " * 700 + "![inside](i.png) " + "tail; " * 300, "", None, " \n ", "#x no heading.\n# \n", "no mark",
]


def test_sentences_are_those_of_the_other_splitter(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    want = sorted((r.doc_id, r.idx, r.sentence, r.is_heading, r.heading_level) for r in segment.sentences(docs).collect())
    got = docs.select("doc_id", "text", F.posexplode(lineage.places("text")).alias("idx", "x")).collect()
    assert sorted((r.doc_id, r.idx, r.text[r.x.start : r.x.end], r.x.is_heading, r.x.heading_level) for r in got) == want


def test_chunks_are_those_of_the_other_builder(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    columns = ["doc_id", "chunk_index", "content", "token_count", "section_title", "section_level", "content_hash"]
    assert sorted(map(tuple, lineage.chunks(docs).select(columns).collect())) == sorted(map(tuple, segment.chunks(docs).select(columns).collect()))


def test_every_slice_is_its_content(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    chunked = lineage.chunks(docs)
    cut = lineage.pieces(chunked)
    for rows in (chunked, cut):
        told = lineage.anchors(rows).collect()
        assert told and all(TEXTS[r.doc_id][r.char_start : r.char_end] == r.content for r in told)
        ids = [r.anchor_id for r in told if r.parent_id is None]
        assert all(r.parent_id in ids for r in told if r.kind == "figure")
    parts = [r for r in cut.collect() if r.doc_id == 1 and r.parent_id]
    assert len(parts) > 2 and len({r.chunk_id for r in parts}) == len(parts)
    for r in parts:  # a piece is what its anchors hold, put together
        assert "\n".join(a.content for a in r.anchors).strip() == r.content
    assert {r.chunk_id for r in parts if any(a.figures for a in r.anchors)}
    by_place = {r.char_start: r for r in chunked.where("doc_id = 0").collect()}
    paths = [by_place[k].heading_path for k in sorted(by_place)]
    assert paths == [["One"], ["One", "Two"], ["One", "Two", "Three"], ["One", "Four"]]
    assert [by_place[k].has_image for k in sorted(by_place)] == [False, True, False, False]
    assert "Exchange" not in chunked._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_found_once(spark):
    """Texts go to Python once for their sentences and once for their cuts, and no content is sliced from a whole text again; texts without a sentence have no chunk."""
    docs = spark.createDataFrame([(1, "# A\n![f](x.png) One. " + "word " * 900 + "end."), (2, None), (3, " \n ")], "doc_id long, text string")
    found = lineage.anchors(lineage.chunks(docs))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "substr(text" not in plan and "substr(_text" not in plan
    assert {r.doc_id for r in found.collect()} == {1}
    assert [(r.anchor_id, r.parent_id, r.content) for r in found.where("kind = 'figure'").collect()] == [("1_0_1_fig0", "1_0_1", "![f](x.png)")]
    cut = lineage.anchors(lineage.pieces(lineage.chunks(docs)))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    assert cut.select("chunk_id").distinct().count() > 1


def test_workers_get_bounded_batches(spark):
    """Whatever a session had set: texts by thousands in one batch make a worker's memory grow with the table until batches are full."""
    from folioflow.session import ship

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
