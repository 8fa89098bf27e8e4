"""Chunks that know where they come from: sentences, headings and figures with their places in the text, kept through cuts.

A text's sentences are found once, in one pass that takes their contents along (to slice a text by places means to count from its start each time), and
stay in one row until chunks are cut, so nothing is shuffled. Every anchor's slice of the text is its content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import content_hash, estimate_tokens
from folioflow.operators.segment import MAX_TOKENS, cut_oversized, heading_paths, rule_boundaries

# White space as Unicode has it, without the separators that Python adds.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_HEADING = re.compile(f"#{{1,6}}(?=[{_WS}])")
_END = re.compile(f"[。！？；]|[.!?;](?=[{_WS}]|\\Z)")
_BLANK_START, _BLANK_END = re.compile(f"[{_WS}]*"), re.compile(f"[{_WS}]*\\Z")
_FIGURE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")
#: Texts whose sentences a Python worker holds at once.
AT_ONCE = 64
ITEMS = "array<struct<start:int,end:int,is_heading:boolean,heading_level:int,n_headings:int,content:string,figures:array<struct<start:int,end:int,description:string,path:string>>>>"


def sentence_places(text: str) -> list[tuple[int, int, int]]:
    """(start, end, heading level or 0) of the sentences: heading lines are whole, other text ends after its end marks, blanks around are left out."""
    out: list[tuple[int, int, int]] = []

    def plain(start: int, end: int) -> None:
        run, at = text[start:end], 0
        for stop in [*(m.end() for m in _END.finditer(run)), len(run)]:
            piece = run[at:stop]
            first = _BLANK_START.match(piece).end()
            last = _BLANK_END.search(piece, first).start()
            if first < last:
                out.append((start + at + first, start + at + last, 0))
            at = stop

    since = at = 0
    for line in text.split("\n"):
        m = _HEADING.match(line)
        if m:
            plain(since, at)
            out.append((at, at + len(line), m.end()))
            since = at + len(line)
        at += len(line) + 1
    plain(since, len(text))
    return out


def _items(text: str | None) -> list[dict]:
    found, headings = [], 0
    for start, end, level in sentence_places(text or ""):
        content, headings = text[start:end], headings + (level > 0)
        figures = [{"start": start + m.start(), "end": start + m.end(), "description": m[1], "path": m[2]} for m in _FIGURE.finditer(content)]
        found.append({"start": start, "end": end, "is_heading": level > 0, "heading_level": level, "n_headings": headings, "content": content, "figures": figures})
    return found


def places(c: Column | str) -> Column:
    """The sentences of a text with their places, how many headings there are up to each, and the figures in them."""

    @F.pandas_udf(ITEMS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for at in range(0, len(texts), AT_ONCE):  # sentences take many times the room of their text
                yield texts.iloc[at : at + AT_ONCE].map(_items)

    return run(c)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk_id, char_start, char_end, content, token_count, section_title, section_level, heading_path, has_image, anchors) by rule boundaries.

    ``anchors`` are the chunk's sentences (anchor_id, kind, start, end, content, figures); a heading path is that of the last heading up to the chunk's
    first sentence, itself included. Null texts and texts without a sentence have no chunks.
    """
    # no filter on the sentences before the parts are cut: it would be pushed below them and find them a second time
    rows = docs.select(id_col, places(text_col).alias("_items"))

    def item(x: Column, i: Column) -> Column:
        same = (x[c].alias(c) for c in ("start", "end", "is_heading", "heading_level", "n_headings", "content", "figures"))
        return F.struct(i.alias("idx"), *same, estimate_tokens(x["content"]).alias("tokens"))

    rows = rows.select(id_col, F.transform("_items", item).alias("items"))
    heads = F.filter("items", lambda x: x["is_heading"])
    title = lambda x: F.regexp_replace(x["content"], r"(?U)\A#+\s*", "")
    titled = F.transform(heads, lambda x: F.struct(title(x).alias("title"), x["heading_level"].alias("level")))
    rows = rows.select(id_col, "items", rule_boundaries(F.col("items")).alias("cuts"), F.transform(heads, title).alias("titles"), heading_paths(titled).alias("paths"))
    last = F.size("items") - 1
    ends = F.array_sort(F.array_union(F.filter("cuts", lambda c: c < last), F.array(last)))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))

    def part(a: Column, b: Column) -> Column:
        before = F.get("items", a)["n_headings"]
        path = F.when(before > 0, F.concat(F.get("paths", before - 1), F.array(F.get("titles", before - 1)))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.slice("items", a + 1, b - a + 1).alias("items"), path.alias("path"))

    out = rows.select(id_col, F.posexplode(F.zip_with(starts, ends, part)).alias("chunk_index", "_p")).select(id_col, "chunk_index", "_p.*").where(F.size("items") > 0)
    head = F.get(F.filter("items", lambda x: x["is_heading"]), F.lit(0))
    out = out.withColumn("content", F.array_join(F.transform("items", lambda x: x["content"]), "\n"))
    content = F.col("content")
    chunk_id = F.concat_ws("_", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"))
    anchor = lambda x: F.struct(F.concat(chunk_id, F.lit("_"), x["idx"].cast("string")).alias("anchor_id"), F.when(x["is_heading"], "heading").otherwise("sentence").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["content"].alias("content"), x["figures"].alias("figures"))
    return out.select(
        id_col, "chunk_index", chunk_id.alias("chunk_id"), F.get("items", F.lit(0))["start"].alias("char_start"), F.element_at("items", -1)["end"].alias("char_end"), "content", estimate_tokens(content).alias("token_count"),
        F.coalesce(title(head), F.lit("")).alias("section_title"), F.coalesce(head["heading_level"], F.lit(0)).alias("section_level"), F.col("path").alias("heading_path"),
        F.exists("items", lambda x: F.size(x["figures"]) > 0).alias("has_image"), content_hash(content).alias("content_hash"), F.transform("items", anchor).alias("anchors"),
    )


def cut_places(sizes: list[int], content: str) -> list[dict]:
    """The pieces of an oversized chunk, its sentences of these sizes joined by single characters: for each its content and of which sentences it holds which part."""
    begin, at = [], 0
    for n in sizes:
        begin.append(at)
        at += n + 1
    out = []
    for start, end, piece in cut_oversized(content):
        held = [{"item": i, "start": max(0, start - b), "end": min(n, end - b)} for i, (b, n) in enumerate(zip(begin, sizes, strict=True)) if b < end and b + n > start]
        out.append({"content": piece, "held": held})
    return out


def _cut(sizes: Column, contents: Column) -> Column:
    @F.pandas_udf("array<struct<content:string,held:array<struct<item:int,start:int,end:int>>>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, contents in batches:
            for at in range(0, len(sizes), AT_ONCE):
                rows = zip(sizes.iloc[at : at + AT_ONCE], contents.iloc[at : at + AT_ONCE], strict=True)
                yield pd.Series([None if c is None else cut_places(list(s), c) for s, c in rows], dtype=object)

    return run(sizes, contents)


def pieces(chunked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks of over ``MAX_TOKENS`` as overlapping pieces, others as they are: (id, chunk_index, piece, chunk_id, parent_id, content, token_count, anchors).

    A piece has the anchors of the sentences that it holds a part of, narrowed to that part. ``parent_id`` is the chunk that was cut.
    """
    big = F.col("token_count") > MAX_TOKENS  # a null count too is not big
    # chunks come to be once: a union of the cut and the others would make them twice
    sizes = F.when(big, F.transform("anchors", lambda x: F.length(x["content"])))
    cut = chunked.withColumn("_cut", _cut(sizes, F.when(big, F.col("content"))))

    def narrowed(h: Column) -> Column:
        x = F.get("anchors", h["item"])
        start, end = x["start"] + h["start"], x["start"] + h["end"]
        inside = F.filter(x["figures"], lambda f: (f["start"] >= start) & (f["end"] <= end))
        return F.struct(x["anchor_id"].alias("anchor_id"), x["kind"].alias("kind"), start.alias("start"), end.alias("end"), F.substr(x["content"], h["start"] + 1, h["end"] - h["start"]).alias("content"), inside.alias("figures"))

    whole = F.struct(F.col("content").alias("content"), F.col("anchors").alias("anchors"))
    parts = F.when(F.col("_cut").isNull(), F.array(whole)).otherwise(F.transform("_cut", lambda p: F.struct(p["content"].alias("content"), F.transform(p["held"], narrowed).alias("anchors"))))
    was_cut = F.col("_was_cut")
    rows = cut.select(id_col, "chunk_index", F.col("chunk_id").alias("_id"), F.col("_cut").isNotNull().alias("_was_cut"), F.posexplode(parts).alias("piece", "_p"))
    return rows.select(
        id_col, "chunk_index", "piece", F.when(was_cut, F.concat("_id", F.lit("."), F.col("piece").cast("string"))).otherwise(F.col("_id")).alias("chunk_id"), F.when(was_cut, F.col("_id")).alias("parent_id"),
        F.col("_p.content").alias("content"), estimate_tokens("_p.content").alias("token_count"), F.col("_p.anchors").alias("anchors"),
    )


def anchors(chunked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_id, anchor_id, parent_id, kind, char_start, char_end, content): a row for each anchor, and one for each figure in it, whose parent the anchor is."""

    def row(anchor_id: Column, parent: Column, kind: Column, start: Column, end: Column, content: Column) -> Column:
        return F.struct(anchor_id.alias("anchor_id"), parent.alias("parent_id"), kind.alias("kind"), start.alias("char_start"), end.alias("char_end"), content.alias("content"))

    def family(a: Column) -> Column:
        own = row(a["anchor_id"], F.lit(None).cast("string"), a["kind"], a["start"], a["end"], a["content"])
        slice_of = lambda f: F.substr(a["content"], f["start"] - a["start"] + 1, f["end"] - f["start"])
        children = F.transform(a["figures"], lambda f, at: row(F.concat(a["anchor_id"], F.lit("_fig"), at.cast("string")), a["anchor_id"], F.lit("figure"), f["start"], f["end"], slice_of(f)))
        return F.concat(F.array(own), children)

    return chunked.select(id_col, "chunk_id", F.explode("anchors").alias("a")).select(id_col, "chunk_id", F.inline(family(F.col("a"))))
