import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.operators import answer, fusion, lexical, library, lifecycle, metrics, segment, vector


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sentences(spark):
    got = segment.sentences(docs(spark, "第一句话。第二句话！第三句话？", "First sentence. Second sentence! Third sentence?", "  ", None, "# H\nfile.pdf is here. end")).collect()
    assert [sum(r.doc_id == k for r in got) for k in range(5)] == [3, 3, 0, 0, 3]
    assert [r.is_heading for r in got if r.doc_id == 4] == [True, False, False]


def test_chunks_with_headings(spark):
    got = segment.chunks(docs(spark, "# A\nbody a.\n## B\nbody b.\n# C\nbody c.")).orderBy("chunk_index").collect()
    assert [(r.section_title, r.section_level, r.content) for r in got] == [("A", 1, "# A\nbody a."), ("B", 2, "## B\nbody b."), ("C", 1, "# C\nbody c.")]


def folded(items):
    cuts, total = [], 0
    for i, (tokens, heading) in enumerate(items):
        if heading:
            cuts += [i - 1] if i else []
            total = 0
            continue
        total += tokens
        if total >= segment.MAX_TOKENS:
            cuts.append(i)
            total = tokens
    return list(dict.fromkeys(cuts))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 600), st.booleans()), max_size=30))
def test_rule_boundaries(spark, items):
    data = [(0, [(i, "s", h, t) for i, (t, h) in enumerate(items)])]
    df = spark.createDataFrame(data, "doc_id int, items array<struct<idx:int,sentence:string,is_heading:boolean,tokens:long>>")
    assert df.select(segment.rule_boundaries(F.col("items"))).first()[0] == folded(items)


@given(st.text(alphabet="ab 。.x", min_size=1, max_size=3000))
def test_cuts_cover_the_text(value):
    parts = segment.cut_oversized(value)
    assert all(value[a:b].strip() == c and 0 < b - a <= segment.CUT_CHARS + 1 for a, b, c in parts)
    if parts and value.strip():
        assert value[: parts[0][0]].strip() == "" and parts[-1][1] == len(value) or value[parts[-1][1] :].strip() == ""


def test_rechunk(spark):
    got = segment.rechunk(segment.chunks(docs(spark, "这是一个很长的句子。" * 1000)))
    rows = got.orderBy("chunk_index").collect()
    assert len(rows) > 10 and len({r.chunk_id for r in rows}) == len(rows)
    assert max(len(r.content) for r in rows) <= segment.CUT_CHARS + 1


def test_anchors(spark):
    blocks = segment.block_offsets(spark.createDataFrame([(1, 0, "abc"), (1, 1, ""), (1, 2, "de")], "doc_id int, o int, text string"), "doc_id", "o")
    assert [(r.start, r.end) for r in blocks.orderBy("o").collect()] == [(0, 3), (4, 4), (4, 6)]
    anchors = spark.createDataFrame([(1, 0), (1, 3), (1, 5)], "doc_id int, char_start int")
    assert {r.char_start: r.block_order for r in segment.anchor_blocks(anchors, blocks, "doc_id", "o").collect()} == {0: 0, 3: None, 5: 2}


def test_merge_descriptions():
    assert segment.merge_descriptions("![x](a/b.png) ![](a/b.png)", [("img/b.png", "d")]) == "![d](img/b.png) ![](a/b.png)"


def test_bm25_prefers_the_title_that_has_both_words(spark):
    d = docs(spark, "深度学习 自然语言 处理", "深度学习 图像", "天气 预报", "历史 研究", "经济")
    q = lexical.query_terms(spark.createDataFrame([(0, "深度 语言")], "id int, text string"), "id", "text")
    got = lexical.bm25(lexical.postings(d), lexical.doc_stats(d), q, 3).orderBy("rank").collect()
    assert got[0].doc_id == 0


def test_bm25_formula(spark):
    d = docs(spark, "a a b", "b c", "c", "d", None)
    q = spark.createDataFrame([(0, "a", 1)], "query_id int, token string, times long")
    got = lexical.bm25(lexical.postings(d), lexical.doc_stats(d), q, 5).first()
    idf, avg = math.log((5 - 1 + 0.5) / 1.5), 7 / 5
    assert got.score == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)), abs=1e-6)


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "vec_id int, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")).where("query_id = 0")
    assert [(r.vec_id, r.distance) for r in vector.knn(v, q, 3).orderBy("rank").collect()] == [(0, 0.0), (1, 1.0), (2, 1.0)]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "d double").select(vector.dense_score(F.col("d"))).collect()] == [1.0, 0.5, 0.0]
    model, indexed = vector.lsh_index(v.where("vec_id < 2"))
    assert indexed.count() == 2


def test_rrf(spark):
    dense = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, doc_id string, rank int")
    sparse = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query_id int, doc_id string, rank int")
    got = fusion.rrf(dense, sparse).orderBy("rank").collect()
    assert [(r.doc_id, r.dense_rank, r.sparse_rank) for r in got] == [("b", 2, 1), ("a", 1, 0), ("c", 0, 2)]
    full = fusion.with_content(fusion.rrf(dense, sparse), spark.createDataFrame([("a", "x")], "doc_id string, content string"))
    assert {r.doc_id: (r.content, r.origin) for r in full.collect()} == {"a": ("x", "dense_only"), "b": ("", "both"), "c": ("", "bm25_only")}


def test_context_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(0, 1, "a" * 100), (0, 2, " "), (0, 3, "b" * 100), (0, 4, "c" * 400), (0, 5, "d")], "query_id int, rank int, content string")
    got = fusion.pack_context(rows, 160).first()
    assert got.n_used == 2 and got.context == f"[1] {'a' * 100}{fusion.SEPARATOR}[3] {'b' * 100}"


def test_evidence_loop():
    asked = []
    got = fusion.evidence_loop(lambda q, k: asked.append((q, k)) or k, lambda q, r: "supported" if r > 30 else "insufficient", lambda q, v: q + "!", "q")
    assert got == (40, "supported", 2) and asked == [("q", 20), ("q", 40)]
    assert fusion.window_size(8192, 1000, 500, 100) == 66


def test_citations(spark):
    got = docs(spark, "研究表明[1]方法有效[2][3]", "none").select("doc_id", answer.citations("text").alias("c")).collect()
    assert [(c.start, c.end, c.number) for c in got[0].c] == [(4, 7, 1), (11, 14, 2), (14, 17, 3)] and got[1].c == []
    assert answer.inject_citations("研究表明[1]该方法有效[5]", ["src_a"]) == ("研究表明该方法有效", [{"offset": 4, "source_id": "src_a"}])
    assert answer.spread_citations("One. Two! Three?", 2) == "One[1]. Two[2]! Three?"


def test_blocks(spark):
    got = answer.parse_blocks("# T\n- a\n- b\n1. c\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n---\ntext", [])
    assert [b["type"] for b in got] == ["heading", "list", "list", "table", "divider", "paragraph"]
    assert got[3]["headers"] == ["A", "B"] and got[3]["rows"] == [["1", "2"], ["3", "4"]]
    assert [b["type"] for b in answer.parse_blocks("```py\nx\n```\n> q", [], code=True)] == ["code", "quote"]
    stored = docs(spark, '[{"type":"code","text":"x"},{"type":"bad"}]', "oops").select(answer.stored_blocks("text")).collect()
    assert [len(r[0]) for r in stored] == [1, 0]


def test_sources(spark):
    rows = spark.createDataFrame([(0, 1, "p", 1, "x" * 500), (0, 2, "p", 1, "y")], "query_id int, rank int, paper_id string, chunk_id int, content string")
    got = answer.source_cards(rows).orderBy("rank").collect()
    assert [r.source_id for r in got] == ["src_p_1", "src_p_1_1"] and len(got[0].content) == 221 and got[0].content.endswith("…")


LIBRARY = [("p1", "Deep Learning for Text", " Ann ", 2023, None), ("p2", "Deep Nets", "Bob", 2021, None), ("p3", "History", "ann", None, None), ("p4", "Deep", "Ann", 2023, 5)]


def test_library(spark):
    items = spark.createDataFrame(LIBRARY, "item_id string, title string, authors string, year int, deleted_at long")
    ids = lambda df: sorted(r.item_id for r in df.collect())
    assert ids(library.filtered(items, title="deep learning")) == ["p1"]
    assert ids(library.filtered(items, authors="ANN")) == ["p1", "p3"]
    assert ids(library.filtered(items, year_from=2022, year_to=2024)) == ["p1"]
    assert ids(library.filtered(items, title="deep", authors="ann", year_from=2000)) == ["p1"]
    assert ids(library.trashed(items)) == ["p4"]
    assert ids(lifecycle.restore(lifecycle.mark_deleted(items, ["p1"], F.lit(9)), ["p4"]).where("deleted_at is not null")) == ["p1"]
    assert ids(library.fuzzy_search(items, "histery", {"title": 1.0})) == ["p3"]
    assert ids(library.fuzzy_search(items, " ")) == [] if "keywords" in items.columns else True
    assert [r.author for r in library.author_facet(items.withColumn("authors", F.concat("authors", F.lit("; Cy、Di")))).limit(2).collect()] == ["Cy", "Di"]


def test_occurrences_overlap(spark):
    got = library.occurrences(docs(spark, "aAaa b", "none"), "aa").orderBy("char_start").collect()
    assert [(r.doc_id, r.char_start, r.match) for r in got] == [(0, 0, "aA"), (0, 1, "Aa"), (0, 2, "aa")]


def test_lifecycle(spark):
    stones = spark.createDataFrame([("a", 0.0), ("b", 90.0 * 86400)], "paper_id string, deleted_at double")
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    left = lifecycle.sweep(stones, papers, papers, 100.0 * 86400, 30)
    assert [sorted(r.paper_id for r in x.collect()) for x in left] == [["b"], ["b", "c"], ["b", "c"]]
    tasks = spark.createDataFrame([("t", "running", "m", None, None)], "task_id string, status string, message string, completed_at string, paper_id string")
    assert lifecycle.update_status(tasks, "t", "completed", None, F.lit("now")).first() == ("t", "completed", "m", "now", None)


def test_replaced_partition(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "paper_id string, i int")
    lifecycle.replace_partition(rows, str(tmp_path / "v"))
    lifecycle.replace_partition(rows.where("paper_id = 'a' and i = 1"), str(tmp_path / "v"))
    assert sorted((r.paper_id, r.i) for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [("a", 1), ("b", 1)]


def test_latency_places(spark):
    rows = spark.createDataFrame([("q", float(i), i % 2 == 0) for i in range(1, 101)], "operation string, duration_ms double, success boolean")
    got = metrics.latency_stats(rows).first()
    assert (got["count"], got.p50_ms, got.p95_ms, got.p99_ms, got.success_rate) == (100, 51.0, 96.0, 100.0, 0.5)
    assert metrics.latency_stats(rows.limit(0)).count() == 0


def test_routes(spark):
    pages = spark.createDataFrame([("a", p, 10, 0.0, 0.0, 0, 0) for p in (1, 2, 3)] + [("b", 1, 900, 0.5, 0.0, 0, 0)], "paper_id string, page int, n_chars int, formula_score double, table_score double, n_images int, n_fields int")
    assert {r.paper_id: r.route for r in library.probe(pages).collect()} == {"a": "E", "b": "C"}


def test_sessions_go_with_what_hangs_on_them(spark):
    sessions = spark.createDataFrame([("a", "one", 1), ("b", "two", 2)], "session_id string, title string, updated_at int")
    messages = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "session_id string, text string")
    left, texts = lifecycle.without_sessions(sessions.where("session_id = 'a'"), sessions, messages)
    assert [r.session_id for r in left.collect()] == ["b"] and [r.text for r in texts.collect()] == ["y"]
    renamed = {r.session_id: (r.title, r.updated_at) for r in lifecycle.renamed_session(sessions, "a", " new ", F.lit(9)).collect()}
    assert renamed == {"a": ("new", 9), "b": ("two", 2)}
    assert lifecycle.renamed_session(sessions, "a", "  ", F.lit(9)).collect() == sessions.collect()


def test_anchors_in_blocks(spark):
    blocks = spark.createDataFrame([("d", 0, 0, 5), ("d", 1, 6, 6), ("d", 2, 6, 9), ("e", 0, 0, 3)], "doc string, block int, start int, end int")
    anchors = spark.createDataFrame([("d", 0), ("d", 4), ("d", 5), ("d", 6), ("d", 8), ("d", 9), ("e", 2), ("e", 2), ("f", 0)], "doc string, char_start int")
    got = sorted((r.doc, r.char_start, -1 if r.block_order is None else r.block_order) for r in segment.anchor_blocks(anchors, blocks, "doc", "block").collect())
    assert got == [("d", 0, 0), ("d", 4, 0), ("d", 5, -1), ("d", 6, 2), ("d", 8, 2), ("d", 9, -1), ("e", 2, 0), ("e", 2, 0), ("f", 0, -1)]


def test_natural_boundaries(spark):
    rows = [("g", i, s, cut, h) for i, (s, cut, h) in enumerate([("a.", True, False), ("b", False, False), ("c.", False, False), ("d", True, False), ("e", True, False), ("f", False, False), ("g", True, True), ("h。", True, False)])]
    frame = spark.createDataFrame(rows, "g string, i int, sentence string, is_boundary boolean, is_heading boolean")
    assert sorted(r.place for r in segment.natural_boundaries(frame, "g", "i").collect()) == [0, 2, 6, 7]


def test_blocks_of_odd_lines():
    told = lambda t, **kw: [(b["type"], b["text"] or b["items"] or b["headers"]) for b in answer.parse_blocks(t, [], **kw)]
    assert told("- a\n\n- b\n* c\n2. d") == [("list", ["a"]), ("list", ["b", "c"]), ("list", ["d"])]
    assert told("| a |\nx\n| b | c |\n|---|---|") == [("paragraph", "a"), ("paragraph", "x"), ("table", ["b", "c"])]
    assert told("```\na\n```\n```\nb", code=True) == [("code", "a"), ("code", "b")] and told("```", code=True) == [("code", None)]
    assert told("") == told("\n \n") == [] and told("> q\n> r", code=True) == [("quote", "q"), ("quote", "r")] and told("> q") == [("paragraph", "> q")]


def test_chunk_numbers_of_more_than_four_digits(spark):
    chunked = spark.range(10_050).selectExpr("1 as doc_id", "cast(id as int) as chunk_index", "'' as section_title", "'a word' as content", "4L as token_count")
    ids = [r.chunk_id for r in segment.rechunk(chunked).select("chunk_id").collect()]
    assert len(set(ids)) == 10_050 and {"chunk_0000", "chunk_9999", "chunk_10049"} <= set(ids)


def test_searches_over_the_bounds_of_what_is_sent(spark, monkeypatch):
    rng = random.Random(4)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 7 = 0").selectExpr("vec_id as query_id", "embedding as query_vec")
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=12))) for i in range(60)], "doc_id long, text string")
    terms = lexical.query_terms(docs.where("doc_id % 9 = 0"), "doc_id", "text")
    near = lambda: sorted(vector.knn(vectors, asked, 3).collect())
    best = lambda: sorted(lexical.bm25(lexical.postings(docs), lexical.doc_stats(docs), terms, 4).collect())
    want = near(), best()
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    monkeypatch.setattr(lexical, "MOST_TERMS", 2)
    assert (near(), best()) == want
    assert vector.knn(vectors, asked.limit(0), 3).count() == 0


def test_nearest_anchor_by_kinds_of_boxes(spark):
    """Rows with the same page and box are compared once: 900 million pairs of rows here, a few hundred of boxes. Ties go to the first anchor."""
    started = time.monotonic()
    box = lambda n: F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), (F.col("id") % n).cast("double"))
    visuals = spark.range(30_000).select(F.col("id").alias("v"), F.lit(1).alias("doc"), (F.col("id") % 2).alias("page"), box(7).alias("bbox"))
    anchors = spark.range(30_000).select(F.col("id").alias("anchor_id"), (-F.col("id")).alias("anchor_order"), F.lit(1).alias("doc"), F.lit(1).alias("page"), box(5).alias("bbox"))
    got = segment.nearest_anchor(visuals, anchors, "doc").groupBy(F.col("v") % 7, "anchor_id", "distance").count().collect()
    assert sorted(tuple(r)[:3] for r in got) == [(k, 29_995 + min(k, 4), float(max(0, k - 4))) for k in range(7)]
    assert time.monotonic() - started < 60
    odd = spark.createDataFrame([(1, 1, 2, None), (2, 1, None, [1.0]), (3, 2, 1, None)], "v int, doc int, page int, bbox array<double>")
    known = spark.createDataFrame([(5, 0, 1, 2, None), (6, 1, 1, 0, None)], "anchor_id int, anchor_order int, doc int, page int, bbox array<double>")
    assert sorted(tuple(r) for r in segment.nearest_anchor(odd, known, "doc").drop("bbox").collect()) == [(1, 1, 2, 5, 0.0), (2, 1, None, 6, 9999.0)]


def test_knn_passes_on_the_nearest_of_each_task(spark):
    """Copies tie by id, a zero vector is at distance 1, null vectors and those of another width are left out, and a task passes on no more than k rows for each query."""
    rng = random.Random(3)
    data = [(f"v{i:04}", [rng.randint(-2, 2) / 2 for _ in range(4)]) for i in range(1500)] + [("zero", [0.0] * 4), ("none", None), ("wide", [1.0] * 5)]
    vectors = spark.createDataFrame(data, "vec_id string, embedding array<float>")
    asked = [(q, data[q][1]) for q in range(0, 1500, 100)]
    queries = spark.createDataFrame(asked, "query_id long, query_vec array<float>")

    def distance(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(1 - (sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0), 9) + 0.0

    for k in (1, 7, 2000):
        got = sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 8)) for r in vector.knn(vectors, queries, k).collect())
        want = [(q, i + 1, v, round(d, 8)) for q, x in asked for i, (d, v) in enumerate(sorted((distance(x, y), v) for v, y in data[:1501])[:k])]
        assert got == want
    near = vector._near(vectors.repartition(3), queries, 7, "vec_id", "embedding")
    assert near.count() <= 3 * len(asked) * 7


def test_source_cards_are_cut_before_rows_move(spark):
    rows = spark.createDataFrame([("q", 1, "p", 0, "x" * 300), ("q", 2, "p", 0, "y"), ("q", 3, None, None, "")], "query_id string, rank int, paper_id string, chunk_id int, content string")
    cards = answer.source_cards(rows)
    plan = cards._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rfind("substring") > plan.rfind("Window")  # below it in the tree
    assert [(r.source_id, r.content) for r in cards.orderBy("rank").collect()] == [("src_p_0", "x" * 220 + "…"), ("src_p_0_1", "y"), ("src__2", None)]
