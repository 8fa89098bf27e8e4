"""Queries over what comes in: pages before parsing, parts of parsed files, records, requests and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import ACCENTED, UNACCENTED
from folioflow.operators import answer, fusion, library, probing
from folioflow.plans.registry import Tables, literal, query
from folioflow.sources import files

_SQL_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
  '(?i)</t[dh]>', chr(9), 'g'), '(?i)<br\s*/?>|</(?:p|tr|li|div|h[1-6]|title|article|section|nav|footer|header)>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"""
_PAGES_SQL = rf"""WITH t AS (SELECT page_id, page_id // 12 AS paper_id, page_id % 12 + 1 AS page, html, {_SQL_TEXT} AS text FROM pages),
s AS (SELECT *, string_split(text, chr(10)) AS lines, length(text) - length(translate(text, '{probing.FORMULA_SYMBOLS}', '')) AS symbols FROM t),
f AS (SELECT page_id, paper_id, page, length(regexp_replace(text, '^[\s\v]+|[\s\v]+$', '', 'g')) AS n_chars,
  least(1.0::DOUBLE, symbols::DOUBLE / greatest(length(text), 1) * 10 + len(regexp_extract_all(text, '{probing.FORMULA_LATEX}')) * 0.2::DOUBLE + len(regexp_extract_all(text, '(?i){probing.FORMULA_WORDS}')) * 0.1::DOUBLE) AS formula_score,
  least(1.0::DOUBLE, len(regexp_extract_all(text, '(?i){probing.TABLE_WORDS}')) * 0.2::DOUBLE + len(list_filter(lines, lambda x: contains(x, chr(9)) AND regexp_matches(x, '\S')))::DOUBLE / len(lines) * 0.5::DOUBLE) AS table_score,
  len(regexp_extract_all(html, '(?i)<img\b')) AS n_images, len(regexp_extract_all(html, '(?i)<(?:input|select|textarea)\b')) AS n_fields FROM s)"""


def _pages(t: Tables) -> DataFrame:
    """The web pages as pages of papers, twelve each."""
    named = {"paper_id": F.floor(F.col("page_id") / 12), "page": F.col("page_id") % 12 + 1, "text": probing.page_text("html")}
    marks = {"n_images": F.regexp_count("html", F.lit(r"(?i)<img\b")), "n_fields": F.regexp_count("html", F.lit(r"(?i)<(?:input|select|textarea)\b"))}
    return probing.page_features(t.pages.withColumns(named | marks)).drop("html", "text", "url")


@query(f"{_PAGES_SQL} SELECT page_id, n_chars, round(formula_score, 6) AS formula_score, round(table_score, 6) AS table_score, n_images, n_fields FROM f")
def page_features(t: Tables) -> DataFrame:
    return _pages(t).select("page_id", "n_chars", F.round("formula_score", 6).alias("formula_score"), F.round("table_score", 6).alias("table_score"), "n_images", "n_fields")


@query(f"""{_PAGES_SQL}, p AS (SELECT paper_id, count(*) AS n_pages, avg(n_chars) AS density, sum(n_chars) > 100 AS has_text, coalesce(round(avg(formula_score) FILTER (page <= 10), 9), 0) AS formula,
  coalesce(round(avg(table_score) FILTER (page <= 10), 9), 0) AS tables, coalesce(sum(n_images) FILTER (page <= 10), 0)::BIGINT AS images, sum(n_fields)::BIGINT AS fields FROM f GROUP BY paper_id),
m AS (SELECT *, density < 50 AND n_pages > 2 AS s, formula > 0.1 AS f, tables > 0.1 AS t, fields > 0 AS w, images > 0 AS i FROM p)
SELECT paper_id, n_pages, round(density, 6) AS density, has_text, round(formula, 3) AS formula, round(tables, 3) AS tables, images, fields,
  CASE WHEN s THEN 'E' WHEN f AND w AND i THEN 'D' WHEN f OR w OR t THEN 'C' WHEN i THEN 'B' ELSE 'A' END AS route,
  CASE WHEN 3 * s::INT + 2 * f::INT + t::INT + w::INT + i::INT >= 4 THEN 'complex' WHEN 3 * s::INT + 2 * f::INT + t::INT + w::INT + i::INT >= 2 THEN 'moderate' ELSE 'simple' END AS complexity FROM m""")
def page_probe(t: Tables) -> DataFrame:
    """Papers of twelve web pages each: density, formula and table marks, images and fields, and by them a route."""
    return library.probe(_pages(t)).withColumns({"density": F.round("density", 6), "formula": F.round("formula", 3), "tables": F.round("tables", 3)})


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page_text, unnest(range(len(string_split(text, chr(10))))) + 1 AS page FROM documents)
SELECT doc_id, page, (i - 1)::INTEGER AS char_start, (i + 3)::INTEGER AS char_end, substr(page_text, i, 4) AS match
FROM (SELECT * FROM p WHERE contains(lower(page_text), 'enen')), unnest(range(1, length(page_text) + 1)) AS u(i) WHERE lower(substr(page_text, i, 4)) = 'enen'""")
def page_matches(t: Tables) -> DataFrame:
    """Overlapping places of a string by page and place in the page; a document's lines stand for its pages."""
    pages = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("_at", "text")).select("doc_id", (F.col("_at") + 1).cast("long").alias("page"), "text")
    return library.occurrences(pages, "enEN")


NEEDLE = "blesthen"


# DuckDB's levenshtein counts bytes, so what folding leaves beyond ASCII becomes one other character
@query(f"""SELECT * FROM (SELECT conv_id, turn, list_min(list_transform(range(1, length(t) + 1), lambda i: list_min(list_transform(range({len(NEEDLE) - 3}, {len(NEEDLE) + 4}), lambda l: levenshtein(substr(t, i, l), '{NEEDLE}')))))::INTEGER AS distance
  FROM (SELECT *, regexp_replace(translate(lower(text), '{ACCENTED}', '{UNACCENTED}'), '[^\\x00-\\x7F]', '?', 'g') AS t FROM conversations) WHERE length(t) > 0) WHERE distance <= 3""")
def nearest_runs(t: Tables) -> DataFrame:
    """Messages with a run of any length within three edits of a string."""
    return t.conversations.select("conv_id", "turn", library.nearest_run("text", NEEDLE).alias("distance")).where("distance <= 3")


@query("""WITH c AS (SELECT conv_id, turn, text, (1 + length(text) % 3) AS n, (conv_id + turn) % 7 = 0 AS failed FROM conversations),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c)
SELECT conv_id, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (NOT failed), '')) AS markdown, coalesce(string_agg(before || ',' || (before + n - 1), ',' ORDER BY turn) FILTER (NOT failed), '') AS pages,
  sum(n)::BIGINT AS page_count, count(*) AS parts, count(*) FILTER (failed) AS failed FROM o GROUP BY conv_id""")
def merged_parts(t: Tables) -> DataFrame:
    """Messages as parsed parts of a file, some failed, each with a block on its first page and one on its last."""
    n = (1 + F.length("text") % 3).cast("int")
    block = lambda page: F.struct(F.lit("text").alias("type"), F.col("text"), page.cast("int").alias("page_idx"))
    parts = t.conversations.select("conv_id", F.col("turn").alias("part"), n.alias("page_count"), F.to_json(F.array(block(F.lit(0)), block(n - 1))).alias("content_list"), F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, F.col("text")).alias("markdown"))
    places = F.array_join(F.transform("content_list", lambda b: b["page_idx"].cast("string")), ",")
    return files.merged_parts(parts, "conv_id").select("conv_id", F.md5("markdown").alias("markdown"), places.alias("pages"), "page_count", "parts", "failed")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey::VARCHAR END AS item_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS kind,
  CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size::BIGINT END AS pages, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 2 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN p_partkey % 11 = 0 THEN 'no id' END AS rejected FROM part""")
def record_aliases(t: Tables) -> DataFrame:
    """Parts as library records under changing names; every eleventh has none of its fields."""
    id_, odd = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 1
    third = F.col("p_partkey") % 3
    named = F.struct(
        F.when(third == 0, id_).alias("item_id"), F.when(third == 1, id_).alias("library_item_id"), F.when(third == 2, id_).alias("paper_id"), F.col("p_name").alias("title"), F.when(odd, F.lit(" ")).otherwise(F.col("p_type")).alias("file_type"),
        F.col("p_type").alias("kind"), F.when(odd, F.lit(0)).otherwise(F.col("p_size")).alias("page_count"), F.col("p_size").alias("total_pages"), F.when(odd, F.lit("odd")).otherwise(F.lit("failed")).alias("status"),
    )
    raw = t.part.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.lit('{"other": 1}')).otherwise(F.to_json(named)).alias("raw"))
    return library.records(raw, "raw").select("p_partkey", "item_id", "title", "kind", "pages", "status", "rejected")


@query("SELECT doc_id, 'lang=' || coalesce(lang, '-') || ';source=' || coalesce(source, '-') AS fields FROM documents")
def result_fields(t: Tables) -> DataFrame:
    """A hit's fields beside its content."""
    fields = fusion.without(F.create_map(F.lit("content"), F.col("text"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), "content")
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("-"))))
    return t.documents.select("doc_id", F.array_join(pairs, ";").alias("fields"))


@query("SELECT vec_id // 32 AS request, string_agg(vec_id, ',' ORDER BY vec_id % 32) AS ids FROM embeddings GROUP BY ALL")
def response_order(t: Tables) -> DataFrame:
    """Vectors of one request of 32 texts, by their index in it."""
    answers = t.embeddings.select(F.floor(F.col("vec_id") / 32).alias("request"), (F.col("vec_id") % 32).alias("index"), F.col("vec_id").cast("string").alias("id"))
    return fusion.in_order(answers, "request", "index", "id").select("request", F.array_join("values", ",").alias("ids"))


@query(rf"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR text IS NULL OR NOT regexp_matches(text, '\S') THEN {literal(answer.NO_PROMPT)} END AS refused FROM conversations WHERE role = 'user'")
def blank_prompts(t: Tables) -> DataFrame:
    """Questions of users, every third turn blanked; which are refused."""
    asked = t.conversations.where("role = 'user'").withColumn("prompt", F.when(F.col("turn") % 3 == 0, F.lit(" \t\n")).otherwise(F.col("text")))
    return answer.asked(asked).select("conv_id", "turn", "refused")


_STATUS = "(400 + event_id % 200)"
_CODE_SQL = f"CASE WHEN user_id % 6 = 0 THEN 'rate_limit' WHEN user_id % 6 = 1 THEN 'connection' WHEN user_id % 6 = 2 AND {_STATUS} >= 500 THEN 'server_error' WHEN user_id % 6 = 2 THEN 'client_error' WHEN user_id % 6 = 3 THEN 'timeout' ELSE 'unknown' END"
_ERROR = lambda i: " ".join(f"WHEN '{c}' THEN {literal(v[i])}" for c, v in answer.USER_ERRORS.items())


@query(f"""SELECT event_id, code, replace(CASE code {_ERROR(0)} END, '{{}}', {_STATUS}::VARCHAR) AS message, CASE code {_ERROR(1)} END AS retryable, CASE code {_ERROR(2)} END AS suggested_action
FROM (SELECT *, {_CODE_SQL} AS code FROM events WHERE event_type = 'error')""")
def error_messages(t: Tables) -> DataFrame:
    """What users are told of failed requests; the kind of failure follows the user, the status the event."""
    kinds = F.get(F.array(*[F.lit(k) for k in ("rate_limit", "connection", "status", "timeout", "value", "key")]), (F.col("user_id") % 6).cast("int"))
    rows = t.events.where("event_type = 'error'").withColumn("told", answer.user_error(kinds, F.expr(_STATUS)))
    return rows.select("event_id", "told.code", "told.message", "told.retryable", "told.suggested_action")


@query("SELECT source AS paper_id, min(source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' ELSE '.pdf' END) AS path FROM documents WHERE doc_id % 3 < 2 AND source IS NOT NULL GROUP BY source")
def first_pdf(t: Tables) -> DataFrame:
    """The first PDF of each directory; documents stand for stored files, their sources for directories."""
    end = F.get(F.array(F.lit(".PDF"), F.lit(".pdf"), F.lit(".json")), (F.col("doc_id") % 3).cast("int"))
    return files.first_file(t.documents.where("source IS NOT NULL").select(F.col("source").alias("paper_id"), F.concat("source", F.lit("/"), "doc_id", end).alias("path")))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN coalesce(length(text), 0) END AS char_count, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN lang IS NULL THEN '' ELSE 'lang' END END AS metadata_keys,
  CASE WHEN doc_id % 4 <> 0 THEN 2 END AS chunk_count, CASE WHEN doc_id % 4 <> 0 THEN coalesce(source, '') END AS sections, CASE WHEN doc_id % 3 <> 0 THEN coalesce(n_chars, 0) END AS total_chars, CASE WHEN doc_id % 3 <> 0 THEN 0 END AS total_chunks
FROM documents""")
def artefact_counts(t: Tables) -> DataFrame:
    """What the JSON files of documents tell; some are cut off in the middle, some are not there."""
    cut = lambda n, json: F.when(F.col("doc_id") % n == 0, F.lit('{"a": [')).otherwise(json)
    named = F.struct(F.col("source").alias("section_title"))
    stores = t.documents.select(
        "doc_id", cut(5, F.to_json(F.struct(F.col("text").alias("markdown"), F.struct("lang").alias("metadata")))).alias("markdown"),
        cut(4, F.to_json(F.struct(F.array(named, named).alias("chunks")))).alias("structured"), F.when(F.col("doc_id") % 3 != 0, F.to_json(F.struct(F.col("n_chars").alias("total_chars")))).alias("report"),
    )
    told = files.artifacts(stores)
    joined = {c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")) for c in ("metadata_keys", "sections")}
    return told.withColumns(joined).select("doc_id", "char_count", "metadata_keys", "chunk_count", "sections", "total_chars", "total_chunks")
