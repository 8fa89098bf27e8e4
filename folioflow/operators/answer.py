"""From generated text and search results to source cards, citations and typed blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import strip

BLOCK = "struct<type:string,text:string,level:int,ordered:boolean,items:array<string>,headers:array<string>,rows:array<array<string>>,language:string,citations:array<struct<offset:int,source_id:string>>>"
FIELDS = ("type", "text", "level", "ordered", "items", "headers", "rows", "language", "citations")
_HEADING, _DIVIDER, _ROW = re.compile(r"(#{1,6})\s+(.+)"), re.compile(r"---+"), re.compile(r"\|(.+)\|\s*")
_BULLET, _NUMBER, _FENCE, _QUOTE = re.compile(r"[-*]\s+(.+)"), re.compile(r"(\d+)\.\s+(.+)"), re.compile(r"```\s*(\S*)\s*"), re.compile(r">\s?(.*)")
_CITATION = re.compile(r"\[(\d+)\]")


def source_cards(results: DataFrame, group: str = "query_id", order: Column | str = "rank", longest: int = 220, stand_ins: bool = True) -> DataFrame:
    """Results as cards: source_id ``src_{paper}_{chunk}``, a repeated one with its place behind; content cut with an ellipsis.

    An unknown chunk has its place for a stand-in, an unknown paper an empty name, and an empty content is null. Without ``stand_ins`` a card
    that lacks either has no source_id, and contents stay as they are.
    """
    # cut before rows move: a window's sort takes the cards' texts along, not the documents'
    whole = F.nullif(F.col("content"), F.lit("")) if stand_ins else F.col("content")
    cut = F.when(F.length("content") > longest, F.concat(F.substring("content", 1, longest), F.lit("…"))).otherwise(whole)
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    rows = results.withColumn("content", cut).withColumn("_place", place)
    paper, chunk, at = (F.col(c).cast("string") for c in ("paper_id", "chunk_id", "_place"))
    if stand_ins:
        paper, chunk = F.coalesce(paper, F.lit("")), F.coalesce(chunk, at)
    rows = rows.withColumn("_id", F.concat(F.lit("src_"), paper, F.lit("_"), chunk))
    again = F.row_number().over(Window.partitionBy(group, "_id").orderBy("_place")) > 1
    return rows.withColumn("source_id", F.when(again, F.concat("_id", F.lit("_"), at)).otherwise(F.col("_id"))).drop("_place", "_id")


def citations(c: Column | str) -> Column:
    """(start, end, number) of every [n] in the text."""
    c = F.col(c) if isinstance(c, str) else c
    # parts between marks: a mark's place follows from the lengths before it
    marks = F.regexp_extract_all(c, F.lit(r"(\[\d+\])"), F.lit(1))
    parts = F.split(c, r"\[\d+\]", -1)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(parts, i))
        end = start + F.length(F.get(marks, i))
        one = F.struct(start.alias("start"), end.alias("end"), F.regexp_extract(F.get(marks, i), r"(\d+)", 1).cast("int").alias("number"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,number:int>>)").alias("out"))
    places = F.when(F.size(marks) > 0, F.sequence(F.lit(0), F.size(marks) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, zero, step, lambda acc: acc["out"])


def inject_citations(text: str, source_ids: list[str]) -> tuple[str, list[dict]]:
    """The text without its [n], and where in it which source is cited; numbers without a source only go."""
    out, found, size, at = [], [], 0, 0
    for m in _CITATION.finditer(text):
        out.append(text[at : m.start()])
        size += m.start() - at
        at = m.end()
        if 1 <= int(m[1]) <= len(source_ids):
            found.append({"offset": size, "source_id": source_ids[int(m[1]) - 1]})
    return "".join(out) + text[at:], found


#: What a line of markdown may be, in the order in which it is tried.
_KINDS = (("heading", _HEADING), ("divider", _DIVIDER), ("row", _ROW), ("bullet", _BULLET), ("number", _NUMBER), ("quote", _QUOTE))
#: Kinds of which lines that follow each other make one block.
_TOGETHER = frozenset(("row", "bullet", "number", "code"))


def _lines_told(text: str, code: bool, tables: bool) -> Iterator[tuple[str, int, object]]:
    """Each line's kind, the number of the block that it is part of, and what it says."""
    kinds = [(k, p) for k, p in _KINDS if (tables or k != "row") and (code or k != "quote")]
    n, before, fenced = 0, "", False
    for line in text.split("\n"):
        fence = _FENCE.fullmatch(line.strip()) if code and not fenced else None
        if fenced and line.strip().startswith("```"):
            kind, said, fenced = "end", None, False
        elif fenced:
            kind, said = "code", line
        elif fence:
            kind, said, fenced = "code", fence, True
        else:
            kind, said = next(((k, m) for k, p in kinds if (m := p.fullmatch(line))), ("text", line.strip()))
        n += kind != before or kind not in _TOGETHER
        before = kind
        yield kind, n, said


def _block(kind: str, said: list, source_ids: list[str]) -> dict:
    """The fields of a block that these lines make."""
    if kind == "heading":
        return {"type": kind, "level": min(len(said[0][1]), 4), "text": said[0][2].strip()}
    if kind == "row":
        cells = [[c.strip() for c in m[1].split("|")] for m in said]
        if len(cells) > 1:
            return {"type": "table", "headers": cells[0], "rows": cells[2:]}
        kind, said = "text", [" | ".join(cells[0])]
    if kind in ("bullet", "number"):
        return {"type": "list", "ordered": kind == "number", "items": [m[m.lastindex].strip() for m in said]}
    if kind == "code":
        return {"type": kind, "language": said[0][1], "text": "\n".join(said[1:])}
    if kind == "quote":
        return {"type": kind, "text": said[0][1].strip()}
    if kind == "divider":
        return {"type": kind}
    clean, cites = inject_citations(said[0], source_ids)
    return {"type": "paragraph", "text": clean, "citations": cites}


def parse_blocks(text: str, source_ids: list[str], code: bool = False, tables: bool = True) -> list[dict]:
    """Markdown as typed blocks; with ``code`` fences and quotes are blocks too.

    A table's second row is taken for its rule. A single row is a paragraph of its cells.
    """
    runs = groupby(_lines_told(text, code, tables), key=lambda x: x[:2])
    told = [(kind, [said for _, _, said in run]) for (kind, _), run in runs if kind != "end"]
    return [dict.fromkeys(FIELDS) | _block(kind, said, source_ids) for kind, said in told if said != [""]]


def blocks(answers: DataFrame, text: str = "text", sources: str | None = None, code: bool = False) -> DataFrame:
    """Answers with a column ``blocks``; ``sources`` names an array of source ids in citation order. A null text has no blocks."""

    @F.pandas_udf(f"array<{BLOCK}>")
    def run(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([parse_blocks(t or "", list(i) if i is not None else [], code) for t, i in zip(texts, ids, strict=True)])

    return answers.withColumn("blocks", run(F.col(text), F.col(sources) if sources else F.array().cast("array<string>")))


def render_citations(paragraphs: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """Each (key, offset, source_id) with the number its source is shown under; ``?`` for an unknown source."""
    return paragraphs.join(numbers.select("source_id", "number"), "source_id", "left").select(key, "offset", "source_id", F.coalesce(F.col("number").cast("string"), F.lit("?")).alias("shown"))


def spread_citations(text: str, n_sources: int, most: int = 2) -> str:
    """The text with up to ``most`` marks at ends of sentences, sources taken in turn; for answers that cite nothing."""
    if not n_sources:
        return text
    parts = re.split(r"(?<=[。！？.!?])", text)
    ends = [i for i, p in enumerate(parts) if p.strip() and p.rstrip()[-1:] in "。！？.!?"][:most]
    for k, i in enumerate(ends):
        body = parts[i].rstrip()
        parts[i] = f"{body[:-1]}[{k % n_sources + 1}]{body[-1]}" + parts[i][len(body) :]
    return "".join(parts)


def sse_frame(event: Column, data: Column) -> Column:
    """One server-sent event on the wire."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def parse_sse(c: Column | str) -> Column:
    """(event, data) of one frame: data lines joined, comments skipped, ``message`` where no event is named."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.split(c, "\r?\n", -1)
    field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    return F.struct(F.coalesce(F.element_at(field("event"), -1), F.lit("message")).alias("event"), F.array_join(field("data"), "\n").alias("data"))


def stored_blocks(c: Column | str) -> Column:
    """The blocks of a stored JSON column whose type is known; none where it is not valid."""
    c = F.col(c) if isinstance(c, str) else c
    known = F.from_json(c, "array<struct<type:string,text:string>>")
    return F.coalesce(F.filter(known, lambda b: b["type"].isin("paragraph", "heading", "list", "citation_block", "table", "code", "divider")), F.expr("cast(array() as array<struct<type:string,text:string>>)"))


def render(parts: Iterator[str]) -> str:
    """A token stream put together."""
    return "".join(parts)


#: What a user is told of an error. Message, code, whether another try may help, what to do.
USER_ERRORS = {
    "rate_limit": ("当前请求量较大，请稍后再试", True, "请稍后重试"),
    "connection": ("无法连接到 AI 服务，请检查网络后重试", True, "请检查网络"),
    "server_error": ("AI 服务暂时不可用，请稍后再试", True, None),
    "client_error": ("请求被拒绝（状态码 {}）", False, None),
    "timeout": ("请求超时，请稍后再试", True, "请稍后重试"),
    "unknown": ("处理请求时出现错误，请稍后再试", False, None),
}
NO_PROMPT = "请提供问题或内容"


def user_error(kind: Column, status: Column) -> Column:
    """(message, code, retryable, suggested_action) of an error of a kind (rate_limit, connection, status, timeout, any other) and, for ``status``, an HTTP status."""

    def told(code: str) -> Column:
        message, again, action = USER_ERRORS[code]
        parts = [F.lit(x) for x in message.split("{}")]
        return F.struct((F.concat(parts[0], status.cast("string"), parts[1]) if len(parts) > 1 else parts[0]).alias("message"), F.lit(code).alias("code"), F.lit(again).alias("retryable"), F.lit(action).cast("string").alias("suggested_action"))

    known = F.when(kind == "rate_limit", told("rate_limit")).when(kind == "connection", told("connection"))
    known = known.when((kind == "status") & (status >= 500), told("server_error")).when((kind == "status") & status.isNotNull(), told("client_error"))
    return known.when(kind == "timeout", told("timeout")).otherwise(told("unknown"))


def asked(requests: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Requests with ``refused``: what is told where the prompt is missing or blank, else null."""
    return requests.withColumn("refused", F.when(F.coalesce(strip(prompt), F.lit("")) == "", NO_PROMPT))
