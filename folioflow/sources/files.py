"""Readers: stored files, archives of parsed papers, metadata of PDF files, key-value files, JSON stores."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import pdf_year

MAX_UPLOAD = 100 * 1024 * 1024
MARKDOWN = "paper_id string, markdown string, metadata string"
TOMBSTONES = "paper_id string, deleted_at double, chroma_deleted boolean, bm25_deleted boolean"
PARSED = "path string, markdown string, layout string, content_list string, model string, images array<string>, page_count int, error string"
PDF_INFO = "path string, title string, author string, created string, page_count int, fields array<struct<name:string,kind:string,value:string>>, error string"


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int | None = None) -> DataFrame:
    """Files below the folder: path, modificationTime, length, content; in order of their paths where limited."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return rows if limit is None else rows.orderBy("path").limit(limit)


def uploads(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Files as uploads: file_hash, and why one is rejected (null: it is not): its kind, size, or being known by its hash."""
    rows = files.withColumn("file_hash", F.substring(F.sha2("content", 256), 1, 16))
    reject = F.when(~F.lower("path").endswith(".pdf"), "suffix").when(F.col("length") > MAX_UPLOAD, "size").when(F.col("length") == 0, "empty")
    if known is not None:
        rows = rows.join(known.select("file_hash", F.lit(True).alias("_known")).distinct(), "file_hash", "left")
        reject = F.coalesce(reject, F.when(F.col("_known"), "duplicate"))
        return rows.withColumn("rejected", reject).drop("_known")
    return rows.withColumn("rejected", reject)


def read_archive(data: bytes) -> dict:
    """One archive of a parsed paper: the markdown (a ``*full.md`` first), the JSON members, image names, and the page count: of the layout, else the highest page, else the model's length."""
    out: dict = {"markdown": None, "layout": None, "content_list": None, "model": None, "images": [], "page_count": None, "error": None}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted(z.namelist())
            marked = [n for n in names if n.endswith(".md")]
            chosen = next((n for n in marked if n.endswith("full.md")), marked[0] if marked else None)
            if chosen is None:
                return out | {"error": "no markdown"}
            out["markdown"] = z.read(chosen).decode("utf-8", "replace")
            for key, test in (("layout", lambda n: "layout" in n), ("content_list", lambda n: "content_list" in n and "v2" not in n), ("model", lambda n: "model" in n)):
                name = next((n for n in names if n.endswith(".json") and test(n.rsplit("/", 1)[-1])), None)
                out[key] = z.read(name).decode("utf-8", "replace") if name else None
            out["images"] = [n for n in names if re.search(r"\.(?:png|jpe?g|gif|bmp|webp)$", n, re.I)]
    except (zipfile.BadZipFile, KeyError) as e:
        return out | {"error": str(e) or "bad archive"}
    out["page_count"] = _page_count(out)
    return out


def _page_count(member: dict) -> int | None:
    def parsed(key: str) -> object:
        try:
            return json.loads(member[key] or "null")
        except ValueError:
            return None

    layout, content, model = parsed("layout"), parsed("content_list"), parsed("model")
    if isinstance(layout, dict) and layout.get("pdf_info"):
        return len(layout["pdf_info"])
    pages = [b.get("page_idx") for b in content if isinstance(b, dict) and isinstance(b.get("page_idx"), int)] if isinstance(content, list) else []
    if pages:
        return max(pages) + 1
    return len(model) if isinstance(model, list) else None


def archives(files: DataFrame) -> DataFrame:
    """Files (path, content) as parsed papers; a bad archive has an ``error`` and nulls."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([{"path": path} | read_archive(bytes(data)) for path, data in zip(p["path"], p["content"], strict=True)], columns=["path", "markdown", "layout", "content_list", "model", "images", "page_count", "error"]).astype({"page_count": "Int32"})

    return files.select("path", "content").mapInPandas(run, PARSED)


_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)")


def _text(raw: bytes) -> str:
    body = re.sub(rb"\\(.)", rb"\1", raw[1:-1])
    return body[2:].decode("utf-16-be", "replace") if body[:2] == b"\xfe\xff" else body.decode("latin-1")


def read_pdf_info(data: bytes) -> dict:
    """What a PDF's plain objects tell: title, author, date, pages and form fields. Compressed object streams are left to a parser connector."""
    if not data.startswith(b"%PDF"):
        return {"title": None, "author": None, "created": None, "page_count": None, "fields": [], "error": "no PDF"}

    def entry(key: bytes, within: bytes = data) -> str | None:
        m = re.search(rb"/" + key + rb"\s*(\((?:\\.|[^\\()])*\))", within)
        return _text(m[1]).strip() or None if m else None

    kinds = {b"Tx": "text", b"Btn": "button", b"Ch": "choice", b"Sig": "signature"}
    fields = []
    for m in re.finditer(rb"<<(?:[^<>]|<[^<>]*>)*/FT\s*/(Tx|Btn|Ch|Sig)(?:[^<>]|<[^<>]*>)*>>", data):
        fields.append({"name": entry(b"T", m[0]) or "", "kind": kinds[m[1]], "value": entry(b"V", m[0])})
    counts = [int(x) for x in re.findall(rb"/Type\s*/Pages\b[^<>]*?/Count\s+(\d+)", data)]
    return {"title": entry(b"Title"), "author": entry(b"Author"), "created": entry(b"CreationDate"), "page_count": max(counts) if counts else len(re.findall(rb"/Type\s*/Page\b", data)) or None, "fields": fields, "error": None}


def pdf_metadata(files: DataFrame) -> DataFrame:
    """Files (path, content) with title (else the file's name), author, year, page_count and form fields."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([{"path": path} | read_pdf_info(bytes(data)) for path, data in zip(p["path"], p["content"], strict=True)], columns=["path", "title", "author", "created", "page_count", "fields", "error"]).astype({"page_count": "Int32"})

    from folioflow.functions.text import repair_title, stem

    rows = files.select("path", "content").mapInPandas(run, PDF_INFO)
    return rows.withColumns({"title": F.coalesce("title", repair_title(stem("path"))), "year": pdf_year("created")})


def env_pairs(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, value) of KEY=VALUE lines; comments, blank and other lines are left out, quotes around values go."""
    pattern = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    rows = lines.where(~F.col(line).rlike(r"^\s*(#|$)")).where(F.col(line).rlike(pattern))
    return rows.select(F.regexp_extract(line, pattern, 1).alias("key"), F.regexp_replace(F.regexp_extract(line, pattern, 2), "^([\"'])(.*)\\1$", "$2").alias("value"))


def markdown_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKDOWN).option("multiLine", "true").json(path)


def tombstone_store(spark: SparkSession, path: str) -> DataFrame:
    """Soft deletes; lines that are no records are left out."""
    return spark.read.schema(TOMBSTONES).option("mode", "DROPMALFORMED").json(path).where(F.col("paper_id").isNotNull())


def content_blocks(c: Column | str) -> Column:
    """A content list as an array of blocks, with an explicit schema."""
    return F.from_json(c, "array<struct<type:string,text:string,page_idx:int,bbox:array<double>,img_path:string>>")


def shift_pages(blocks: Column, by: Column) -> Column:
    return F.transform(blocks, lambda b: b.withField("page_idx", b["page_idx"] + by))


def merged_parts(parts: DataFrame, key: str = "path") -> DataFrame:
    """Parsed page ranges (key, part, page_count, markdown, content_list) as one document each: markdown two new lines apart, blocks in one list, their pages moved by those of the parts before.

    A part whose markdown is null has failed: its pages count, its text and blocks are left out. Blocks that are no JSON are left out.
    """
    before = F.coalesce(F.sum("page_count").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    failed = F.col("markdown").isNull()
    blocks = F.coalesce(shift_pages(content_blocks(F.col("content_list")), F.col("_before")), content_blocks(F.lit("[]")))
    rows = parts.withColumn("_before", before)
    kept = F.array_sort(F.collect_list(F.when(~failed, F.struct("part", "markdown", blocks.alias("blocks")))))
    merged = rows.groupBy(key).agg(kept.alias("_kept"), F.sum("page_count").alias("page_count"), F.count(F.lit(1)).alias("parts"), F.count(F.when(failed, 1)).alias("failed"))
    text = F.array_join(F.transform("_kept", lambda x: x["markdown"]), "\n\n")
    return merged.select(key, text.alias("markdown"), F.flatten(F.transform("_kept", lambda x: x["blocks"])).alias("content_list"), "page_count", "parts", "failed")


def first_file(files: DataFrame, key: str = "paper_id", suffixes: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """(key, path): the first file by name of each document that has one of the suffixes, in any case."""
    from folioflow.functions.text import suffix

    return files.where(suffix("path").isin(*suffixes)).groupBy(key).agg(F.min("path").alias("path"))


def artifacts(rows: DataFrame) -> DataFrame:
    """What a document's JSON files (columns markdown, structured, report; null: no such file) tell: sizes, keys, section names in order; a file that is broken tells nothing, a value it lacks is 0 or none."""
    broken = {"columnNameOfCorruptRecord": "_broken"}
    md = F.from_json("markdown", "markdown string, metadata map<string,string>, _broken string", broken)
    st = F.from_json("structured", "chunks array<struct<section_title:string>>, _broken string", broken)
    rp = F.from_json("report", "total_chunks bigint, total_chars bigint, stages map<string,string>, _broken string", broken)
    whole = lambda c, x: F.when(c.isNotNull() & c["_broken"].isNull(), x)
    no_names = F.array().cast("array<string>")
    titles = F.filter(F.transform(st["chunks"], lambda x: x["section_title"]), lambda x: F.coalesce(x, F.lit("")) != "")
    out = {
        "char_count": whole(md, F.coalesce(F.length(md["markdown"]), F.lit(0))), "metadata_keys": whole(md, F.coalesce(F.array_sort(F.map_keys(md["metadata"])), no_names)),
        "chunk_count": whole(st, F.coalesce(F.size(st["chunks"]), F.lit(0))), "sections": whole(st, F.coalesce(F.array_sort(F.array_distinct(titles)), no_names)),
        "total_chunks": whole(rp, F.coalesce(rp["total_chunks"], F.lit(0))), "total_chars": whole(rp, F.coalesce(rp["total_chars"], F.lit(0))),
        "stages": whole(rp, F.coalesce(F.array_sort(F.map_keys(rp["stages"])), no_names)),
    }
    return rows.withColumns(out).drop("markdown", "structured", "report")
