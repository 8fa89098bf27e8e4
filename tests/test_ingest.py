"""Page features, bit-parallel search, records, merged parts and artefacts, on odd rows."""

from itertools import product

from pyspark.sql import functions as F

from folioflow.operators import answer, fusion, library, probing
from folioflow.sources import files


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(text, needle):
    return min(edits(text[i:j], needle) for i in range(len(text) + 1) for j in range(i, len(text) + 1))


def test_nearest_run_equals_brute_force(spark):
    texts = ["".join(p) for n in range(6) for p in product("abc", repeat=n)][::3] + ["", "xxabdxx", "Ärger übt", "zzzzzzzzzz", "𝒳abca𝒳"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    for needle in ("abca", "b", "aabbcc", "arger"):
        got = df.select("text", library.nearest_run("text", needle).alias("d")).collect()
        fold = lambda t: (t or "").lower().replace("ä", "a").replace("ü", "u")
        assert [r.d for r in got] == [nearest(fold(r.text), needle) for r in got]


def test_nearest_run_of_the_longest_needle(spark):
    needle = ("abcdefghij" * 7)[:62]
    df = spark.createDataFrame([("x" * 500 + needle + "y" * 500,), ("x" * 9 + needle[:30] + needle[31:] + "z",), (needle[1:],), ("q" * 100,)], "text string")
    assert [r[0] for r in df.select(library.nearest_run("text", needle)).collect()] == [0, 1, 1, 62]


def test_fuzzy_search_keeps_what_the_filter_must_not_lose(spark):
    items = spark.createDataFrame([(1, "Deep learning", None, None), (2, "Dep laerning", "x", ""), (3, "cooking", "y", "deep lerning"), (4, None, None, None), (5, "deep", "z", "w")], "item_id long, title string, authors string, keywords string")
    far = {c: F.least(library.fuzzy_distance(c, "deep learning"), F.lit(1.0)) for c in ("title", "authors", "keywords")}
    expected = {r.item_id for r in items.where(F.least(*far.values()) <= 0.4).collect()}
    assert {r.item_id for r in library.fuzzy_search(items, "deep learning").collect()} == expected == {1, 2, 3}


def test_page_features(spark):
    rows = [("a", "∑∑∑∑"), ("b", r"see \frac and \sqrt, Equation (3)"), ("c", "Table 1\na\tb\n\t\nc"), ("d", ""), ("e", None), ("f", "plain words")]
    got = {r.id: (r.n_chars, round(r.formula_score, 6), round(r.table_score, 6)) for r in probing.page_features(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"a": (4, 1.0, 0.0), "b": (33, 0.5, 0.0), "c": (15, 0.0, 0.325), "d": (0, 0.0, 0.0), "e": (0, 0.0, 0.0), "f": (11, 0.0, 0.0)}


def test_page_text_keeps_lines_and_cells(spark):
    html = "<table><tr><td>a</td><td>b</td></tr></table><script>var x='</p>';</script><p>one<br>two</p><!-- no -->"
    assert spark.range(1).select(probing.page_text(F.lit(html))).first()[0] == "a\tb\t\none\ntwo\n"


def test_probe_reads_ten_pages_for_scores(spark):
    rows = [("p", n, 10, 1.0 if n > 10 else 0.0, 0.0, 1 if n > 10 else 0, 0) for n in range(1, 13)] + [("q", 1, 500, 0.5, 0.5, 2, 1)]
    got = {r.paper_id: (r.route, r.complexity, r.images, r.has_text) for r in library.probe(spark.createDataFrame(rows, "paper_id string, page int, n_chars int, formula_score double, table_score double, n_images int, n_fields int")).collect()}
    assert got == {"p": ("E", "moderate", 0, True), "q": ("D", "complex", 2, True)}


def test_merged_parts_move_pages_and_count_failures(spark):
    block = '[{"type": "text", "text": "%s", "page_idx": %d}]'
    rows = [("f", 2, 3, "three", block % ("c", 2)), ("f", 0, 2, "one", block % ("a", 1)), ("f", 1, 4, None, block % ("b", 0)), ("g", 0, 1, None, None), ("h", 0, 1, "x", "no json")]
    got = {r.path: r for r in files.merged_parts(spark.createDataFrame(rows, "path string, part int, page_count int, markdown string, content_list string")).collect()}
    f = got["f"]
    assert (f.markdown, [(b.text, b.page_idx) for b in f.content_list], f.page_count, f.parts, f.failed) == ("one\n\nthree", [("a", 1), ("c", 8)], 9, 3, 1)
    assert (got["g"].markdown, got["g"].content_list, got["g"].failed) == ("", [], 1)
    assert (got["h"].markdown, got["h"].content_list, got["h"].failed) == ("x", [], 0)


def test_records_of_odd_json(spark):
    rows = [(1, '{"paper_id": "a", "kind": "pdf", "file_type": " ", "total_pages": 7, "page_count": 0, "status": "failed", "year": 2020, "keywords": ["k"]}'), (2, '{"title": "no id"}'), (3, '{"item_id": "c"'), (4, None), (5, '{"item_id": " d ", "status": "odd"}')]
    got = {r.n: r for r in library.records(spark.createDataFrame(rows, "n int, raw string"), "raw").collect()}
    assert (got[1].item_id, got[1].kind, got[1].pages, got[1].status, got[1].year, got[1].keywords, got[1].rejected) == ("a", "pdf", 7, "failed", 2020, ["k"], None)
    assert [got[n].rejected for n in (2, 3, 4, 5)] == ["no id", "broken", "broken", None]
    assert (got[5].item_id, got[5].status, got[5].keywords, got[5].pages) == ("d", "ready", [], 0)


def test_errors_and_blank_prompts(spark):
    rows = [("status", 503), ("status", 404), ("status", None), (None, None), ("timeout", None)]
    got = spark.createDataFrame(rows, "kind string, status int").select(answer.user_error(F.col("kind"), F.col("status")).alias("e")).collect()
    assert [(r.e.code, r.e.retryable) for r in got] == [("server_error", True), ("client_error", False), ("unknown", False), ("unknown", False), ("timeout", True)]
    assert "404" in got[1].e.message
    asked = answer.asked(spark.createDataFrame([(None,), ("  　",), ("why?",)], "prompt string")).collect()
    assert [r.refused is None for r in asked] == [False, False, True]


def test_artifacts_and_first_files(spark):
    rows = [("a", '{"markdown": "abc", "metadata": {"y": 1, "x": 2}}', '{"chunks": [{"section_title": "s"}, {"section_title": ""}, {}]}', '{"total_chunks": 3, "stages": {"clean": {"ms": 2}}}'), ("b", "{", None, "[]"), ("c", "{}", "{}", "{}")]
    got = {r.id: r for r in files.artifacts(spark.createDataFrame(rows, "id string, markdown string, structured string, report string")).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.char_count, a.metadata_keys, a.chunk_count, a.sections, a.total_chunks, a.total_chars, a.stages) == (3, ["x", "y"], 3, ["s"], 3, 0, ["clean"])
    assert (b.char_count, b.chunk_count) == (None, None)
    assert (c.char_count, c.metadata_keys, c.chunk_count, c.sections, c.total_chunks, c.stages) == (0, [], 0, [], 0, [])
    named = spark.createDataFrame([("p", "p/b.pdf"), ("p", "p/a.PDF"), ("p", "p/0.txt"), ("q", "q/x.docx")], "paper_id string, path string")
    assert [tuple(r) for r in files.first_file(named).collect()] == [("p", "p/a.PDF")]


def test_fields_and_order(spark):
    m = spark.range(1).select(fusion.without(F.create_map(F.lit("content"), F.lit("x"), F.lit("a"), F.lit("y")), "content").alias("m")).first().m
    assert m == {"a": "y"}
    rows = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "request long, index int, id string")
    assert {r.request: r["values"] for r in fusion.in_order(rows, "request", "index", "id").collect()} == {1: ["a", "b", "c"], 2: ["z"]}
