"""From texts to sentences, boundaries, chunks and anchors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import content_hash, estimate_tokens, strip

MAX_TOKENS = 512
#: Oversized chunks are cut at so many characters, and each cut takes so many of the one before it along.
CUT_CHARS, OVERLAP_CHARS, LOOK_BACK = 768, 76, 200
SENTENCE_END = r"[。！？；]|[.!?;](?=\s|\z)"


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, sentence, is_heading, heading_level): heading lines are whole, other text ends after its end marks; blank ones are left out.

    Lines become rows of runs between headings within one array expression, so nothing is shuffled.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    heading = lambda x: x.rlike(r"(?U)\A#{1,6}\s")
    # a heading becomes a segment of its own; \u0001 cannot come from a line
    marked = F.array_join(F.transform(lines, lambda x: F.when(heading(x), F.concat(F.lit("\u0001"), x, F.lit("\u0001"))).otherwise(x)), "\n")
    segments = F.split(marked, "\u0001", -1)

    def parts(s: Column) -> Column:
        cut = F.split(F.regexp_replace(s, f"(?U)({SENTENCE_END})", "$1\u0002"), "\u0002", -1)
        plain = F.filter(F.transform(cut, lambda x: F.struct(strip(x).alias("sentence"), F.lit(False).alias("is_heading"), F.lit(0).alias("heading_level"))), lambda x: x["sentence"] != "")
        level = F.length(F.regexp_extract(s, r"\A(#+)", 1))
        return F.when(heading(s) & ~s.contains("\n"), F.array(F.struct(s.alias("sentence"), F.lit(True).alias("is_heading"), level.alias("heading_level")))).otherwise(plain)

    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.flatten(F.transform(segments, parts))).alias("idx", "_s"))
    return rows.select(id_col, "idx", "_s.*")


def rule_boundaries(items: Column) -> Column:
    """The places after which a chunk ends, from an array of (sentence, is_heading): before a heading, and where ``MAX_TOKENS`` are reached.

    The sentence that reaches the limit counts for the next chunk too.
    """
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).cast("long").alias("tokens"))

    def step(acc: Column, x: Column) -> Column:
        tokens = x["tokens"]
        total = acc["tokens"] + tokens
        over = total >= MAX_TOKENS
        cut = F.when(x["is_heading"], F.when(x["idx"] > 0, F.array(x["idx"] - 1)).otherwise(F.array().cast("array<int>"))).when(over, F.array(x["idx"])).otherwise(F.array().cast("array<int>"))
        return F.struct(F.concat(acc["cuts"], cut).alias("cuts"), F.when(x["is_heading"], F.lit(0).cast("long")).when(over, tokens).otherwise(total).alias("tokens"))

    return F.aggregate(items, start, step, lambda acc: F.array_distinct(acc["cuts"]))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, content, n_sentences, token_count, section_title, section_level, chunk_type, content_hash) by rule boundaries."""
    rows = sentences(docs, id_col, text_col)
    item = F.struct("idx", "sentence", "is_heading", "heading_level", estimate_tokens("sentence").alias("tokens"))
    per_doc = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("items"))
    per_doc = per_doc.withColumn("cuts", rule_boundaries(F.col("items")))
    return _built(per_doc, id_col)


def _built(per_doc: DataFrame, id_col: str) -> DataFrame:
    last = F.size("items") - 1
    ends = F.array_sort(F.array_union(F.filter("cuts", lambda c: c < last), F.array(last)))
    # the parts are cut before they become rows, so that no row carries its whole document
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
    parts = F.zip_with(starts, ends, lambda a, b: F.slice("items", a + 1, b - a + 1))
    out = per_doc.select(id_col, F.posexplode(parts).alias("chunk_index", "part")).where(F.size("part") > 0)
    head = F.get(F.filter("part", lambda x: x["is_heading"]), F.lit(0))
    content = F.array_join(F.transform("part", lambda x: x["sentence"]), "\n")
    title = F.regexp_replace(head["sentence"], r"(?U)\A#+\s*", "")
    return out.select(
        id_col, F.col("chunk_index").cast("int").alias("chunk_index"), content.alias("content"), F.size("part").alias("n_sentences"), estimate_tokens(content).alias("token_count"),
        F.coalesce(title, F.lit("")).alias("section_title"), F.coalesce(head["heading_level"], F.lit(0)).alias("section_level"),
        F.when(head.isNotNull(), "heading").otherwise("paragraph").alias("chunk_type"), content_hash(content).alias("content_hash"),
    )


def cut_oversized(text: str, size: int = CUT_CHARS, overlap: int = OVERLAP_CHARS, back: int = LOOK_BACK) -> list[tuple[int, int, str]]:
    """(start, end, stripped text) of the pieces of a long text: each ends after the last end mark in reach, and the next begins ``overlap`` before."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            least = max(at + size // 2, end - back)
            mark = max(text.rfind(c, least + 1, end + 1) for c in "。！？.!?;")
            end = mark + 1 if mark > least else end
        piece = text[at:end].strip()
        if piece:
            out.append((at, end, piece))
            at = end - overlap if end < n else end
        else:
            at = end
    return out


def rechunk(chunked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks of over ``MAX_TOKENS`` as overlapping pieces with their place in the parent; all numbered anew within the document by (parent, piece)."""

    @F.pandas_udf("array<struct<start:int,end:int,content:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "content": c} for a, b, c in cut_oversized(t)])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("content").alias("end"), F.col("content").alias("content")))
    big = F.col("token_count") > MAX_TOKENS
    few = chunked.where(~big).select(id_col, F.col("chunk_index").alias("parent_index"), "section_title", F.lit(False).alias("was_cut"), whole.alias("pieces"))
    many = chunked.where(big).select(id_col, F.col("chunk_index").alias("parent_index"), "section_title", F.lit(True).alias("was_cut"), cut("content").alias("pieces"))
    rows = few.unionByName(many).select(id_col, "parent_index", "section_title", "was_cut", F.posexplode("pieces").alias("piece", "_p"))
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("parent_index", "piece")) - 1
    return rows.select(id_col, number.alias("chunk_index"), "parent_index", "piece", F.col("_p.start").alias("char_start"), F.col("_p.end").alias("char_end"), F.col("_p.content").alias("content"), estimate_tokens("_p.content").alias("token_count"), "section_title", "was_cut", F.format_string("chunk_%04d", number).alias("chunk_id"))


def embedding_boundaries(vectors: DataFrame, group: str, order: str, similarity: str = "similarity", window: int = 3, drop: float = 0.3) -> DataFrame:
    """Places where the mean of the last ``window`` similarities falls by more than ``drop`` of the mean before it.

    ``similarity`` is that of a row and the next. The earlier mean is over up to ``window`` values divided by min(place, window).
    """
    by = Window.partitionBy(group).orderBy(order)
    i = F.row_number().over(by) - 1
    now = F.avg(similarity).over(by.rowsBetween(-(window - 1), 0))
    before = F.sum(similarity).over(by.rowsBetween(-window, -1)) / F.least(i, F.lit(window))
    rows = vectors.where(F.col(similarity).isNotNull()).withColumns({"place": i, "mean_now": now, "mean_before": before})
    fall = F.when(F.col("mean_before") > 0, (F.col("mean_before") - F.col("mean_now")) / F.col("mean_before")).otherwise(F.lit(0.0))
    return rows.withColumn("fall", F.when(F.col("place") > 0, fall).otherwise(F.lit(0.0))).withColumn("is_boundary", F.col("fall") > drop)


def natural_boundaries(rows: DataFrame, group: str, order: str, sentence: str = "sentence", boundary: str = "is_boundary", heading: str = "is_heading", back: int = 3) -> DataFrame:
    """(group, place), once each: where chunks of the group end. A boundary moves back to the nearest of ``back`` sentences that ends as one does, itself included and the first of all left out, or stays; every heading is one too."""
    by = Window.partitionBy(group).orderBy(order)
    rows = rows.withColumn("place", F.row_number().over(by) - 1)
    ends = (F.col("place") > 0) & F.col(sentence).rlike(r"[。！？.!?]\s*\z")
    near = F.last(F.when(ends, F.col("place")), ignorenulls=True).over(by.rowsBetween(1 - back, 0))
    places = F.array_compact(F.array(F.when(F.col(boundary), F.coalesce(near, F.col("place"))), F.when(F.col(heading), F.col("place"))))
    return rows.withColumn("_near", places).select(group, F.explode("_near").alias("place")).distinct()


#: Kinds of a parsed page's blocks, and what they are in chunks.
BLOCK_TYPES = {"text": "paragraph", "title": "heading", "table": "table", "equation": "formula", "image": "figure"}


def block_type(kind: Column | str, default: str = "paragraph") -> Column:
    """What a parsed block is in a chunk."""
    table = F.create_map(*(F.lit(x) for pair in BLOCK_TYPES.items() for x in pair))
    return F.coalesce(F.element_at(table, F.col(kind) if isinstance(kind, str) else kind), F.lit(default))


def normalize_headings(lines: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """Adds ``new_level`` to heading rows: at most one more than the heading before it, as a running minimum in closed form."""
    by = Window.partitionBy(group).orderBy(order)
    i = F.row_number().over(by)
    rows = lines.withColumn("_i", i)
    return rows.withColumn("new_level", (F.col("_i") + F.min(F.col(level) - F.col("_i")).over(by.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("_i")


def heading_paths(heads: Column) -> Column:
    """For an array of (title, level) the path above each: the stack is cut to the level, then the title goes on."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc: Column, h: Column) -> Column:
        kept = F.slice(acc["stack"], 1, F.greatest(F.least(F.size(acc["stack"]), h["level"] - 1), F.lit(0)))
        return F.struct(F.concat(kept, F.array(h["title"])).alias("stack"), F.concat(acc["paths"], F.array(kept)).alias("paths"))

    return F.aggregate(heads, start, step, lambda acc: acc["paths"])


def block_offsets(blocks: DataFrame, group: str, order: str, text: str = "text") -> DataFrame:
    """(start, end) of blocks laid end to end with one separator after each; empty blocks take no room."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    step = F.when(size > 0, size + 1).otherwise(0)
    before = F.coalesce(F.sum(step).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumns({"start": before, "end": before + size})


def anchor_blocks(anchors: DataFrame, blocks: DataFrame, group: str, order: str) -> DataFrame:
    """Each anchor with the first block of its document that holds its ``char_start``.

    Blocks that are laid end to end do not overlap, so the last one that starts at or before the anchor is the only one that can hold it: anchors
    and blocks go through one sorted pass over the document, and no pairs are made. Empty blocks hold nothing.
    """
    b = blocks.where(F.col("end") > F.col("start")).select(group, F.col("start").alias("_at"), F.struct(F.col(order).alias("order"), "end").alias("_block"))
    rows = anchors.withColumns({"_at": F.col("char_start"), "_anchor": F.lit(True)}).unionByName(b, allowMissingColumns=True)
    held = F.last("_block", ignorenulls=True).over(Window.partitionBy(group).orderBy("_at"))  # blocks that start at the same place too
    found = rows.withColumn("_held", held).where("_anchor")
    return found.select(*anchors.columns, F.when(F.col("char_start") < F.col("_held.end"), F.col("_held.order")).alias("block_order"))


def nearest_anchor(visuals: DataFrame, anchors: DataFrame, group: str, salts: int = 16) -> DataFrame:
    """Each visual block with the anchor of its document and page (0: any) that is nearest by the distance of their boxes; without boxes 0 on the same page, else 9999; first anchor on ties.

    Distances are those of distinct boxes: of anchors with the same page and box only the first can win, and visual blocks with the same page and box have
    the same nearest anchor. So pairs go by the kinds of boxes on a document's pages and not by rows; those of one document are dealt to ``salts`` tasks.
    """
    place = (group, "page", "bbox")
    first = anchors.groupBy(*place).agg(F.min_by("anchor_id", F.struct("anchor_order", "anchor_id")).alias("anchor_id"), F.min("anchor_order").alias("anchor_order"))
    a = first.select(F.col(group), F.col("anchor_id"), F.col("anchor_order"), F.col("page").alias("_page"), F.col("bbox").alias("_bbox"), F.explode(F.array(*map(F.lit, range(salts)))).alias("_salt"))
    kinds = visuals.select(*place).distinct().withColumn("_salt", F.pmod(F.xxhash64(*place), F.lit(salts)).cast("int"))
    boxes = (F.size("bbox") == 4) & (F.size("_bbox") == 4)
    far = F.sqrt(F.aggregate(F.zip_with("bbox", "_bbox", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    distance = F.when(boxes, far).when(F.col("page") == F.col("_page"), 0.0).otherwise(9999.0)
    met = kinds.join(a, [group, "_salt"]).where((F.col("page") == 0) | (F.col("_page") == 0) | (F.col("page") == F.col("_page"))).withColumn("distance", distance)
    best = met.groupBy(*place).agg(F.min_by(F.struct("anchor_id", "distance"), F.struct("distance", "anchor_order", "anchor_id")).alias("_a"))
    best = best.select(F.col(group).alias("_g"), F.col("page").alias("_p"), F.col("bbox").alias("_b"), "_a")
    same = (F.col(group) == F.col("_g")) & F.col("page").eqNullSafe(F.col("_p")) & F.col("bbox").eqNullSafe(F.col("_b"))
    return visuals.distinct().join(best, same).select(*visuals.columns, "_a.*")


def figures(c: Column | str) -> Column:
    """(description, path) of every image reference in a markdown text."""
    c = F.col(c) if isinstance(c, str) else c
    pattern = r"!\[([^\]]*)\]\(([^)]+)\)"
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("description"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("path"))


def merge_descriptions(text: str, described: list[tuple[str, str]]) -> str:
    """The text with each (path, description) in place of the first reference to a file of that name; it stays an image."""
    for path, description in described:
        name = re.escape(path.rsplit("/", 1)[-1])
        text = re.sub(rf"!?\[[^\]]*\]\([^)]*{name}[^)]*\)", lambda _: f"![{description}]({path})", text, count=1)  # noqa: B023
    return text


def described(df: DataFrame, text: str = "text", items: str = "described") -> DataFrame:
    """merge_descriptions over a column of arrays of (path, description)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p[text] = [merge_descriptions(t or "", [(d["path"], d["description"]) for d in (x if x is not None else [])]) for t, x in zip(p[text], p[items], strict=True)]
            yield p

    return df.mapInPandas(run, df.schema)


Embedder = Callable[[list[str]], list[list[float]]]
