"""Library and conversation queries: filters, search, facets, sorting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import ACCENTED, UNACCENTED, fold_accents, strip

AUTHOR_SEPARATORS = "[,;、]"


def live(items: DataFrame) -> DataFrame:
    return items.where(F.col("deleted_at").isNull())


def trashed(items: DataFrame) -> DataFrame:
    return items.where(F.col("deleted_at").isNotNull()).orderBy(F.desc("deleted_at"), "item_id")


def filtered(items: DataFrame, title: str | None = None, authors: str | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Live items whose title contains ``title`` (any case), whose authors are ``authors`` (any case, stripped), within the years; a missing year fails a year bound."""
    out = live(items)
    if title:
        out = out.where(F.contains(F.lower("title"), F.lit(title.lower())))
    if authors:
        out = out.where(F.lower(F.trim("authors")) == authors.strip().lower())
    if year_from is not None:
        out = out.where(F.col("year") >= year_from)
    if year_to is not None:
        out = out.where(F.col("year") <= year_to)
    return out


def by_id(items: DataFrame, item_id: str) -> DataFrame:
    return items.where(F.col("item_id") == item_id).limit(1)


def by_hash(items: DataFrame, file_hash: str) -> DataFrame:
    return live(items).where(F.col("file_hash") == file_hash).limit(1)


def author_names(authors: Column | str) -> Column:
    a = F.col(authors) if isinstance(authors, str) else authors
    return F.filter(F.transform(F.split(a, AUTHOR_SEPARATORS, -1), strip), lambda x: x != "")


def has_author(items: DataFrame, name: str) -> DataFrame:
    return items.where(F.array_contains(author_names("authors"), name))


def author_facet(items: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent authors, ties by name."""
    return items.select(F.explode(author_names("authors")).alias("author")).groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(k)


def year_facet(items: DataFrame) -> DataFrame:
    return items.where(F.col("year").isNotNull()).select("year").distinct().orderBy(F.desc("year"))


def ordered(items: DataFrame, mode: str = "time") -> DataFrame:
    """Newest first, by year (missing years last), or by title; ties by item_id."""
    keys = {"time": [F.desc("import_time")], "year": [F.coalesce("year", F.lit(0)).desc()], "title": [F.asc("title")]}[mode]
    return items.orderBy(*keys, "item_id")


#: Characters of a needle at most for nearest_run(): a bit of a 64-bit number for each, and two to spare.
NEEDLE = 62


def nearest_run(c: Column | str, needle: str) -> Column:
    """The least edit distance of the needle (up to 62 characters) to any run of the text, the empty one included; case and accents do not matter.

    Bit-parallel (Myers 1999): a column of the distance table is two numbers, a bit for each of the needle's characters, so each character of the text costs a few operations.
    """
    m = len(needle)
    if not 0 < m <= NEEDLE:
        raise ValueError(f"needle of {m} characters")
    c = fold_accents(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    every, last, zero = F.lit((1 << m) - 1), F.lit(1 << (m - 1)), F.lit(0).cast("long")
    chars = F.split(c, "")  # a null or empty text has one empty character, which equals nothing
    folded = needle.lower().translate(str.maketrans(ACCENTED, UNACCENTED))
    places = {ch: sum(1 << i for i, x in enumerate(folded) if x == ch) for ch in dict.fromkeys(folded)}

    def step(s: Column, ch: Column) -> Column:
        equal = zero
        for x, bits in places.items():
            equal = F.when(ch == x, F.lit(bits)).otherwise(equal)
        # each name is a field of a nested struct, so that nothing is computed twice
        a = F.struct(s["up"].alias("up"), s["down"].alias("down"), s["score"].alias("score"), s["best"].alias("best"), equal.alias("eq"))
        return F.get(F.transform(F.array(a), step_of), 0)

    def step_of(s: Column) -> Column:
        across = (((s["eq"].bitwiseAND(s["up"])) + s["up"]).bitwiseXOR(s["up"])).bitwiseOR(s["eq"])
        return F.get(F.transform(F.array(F.struct(s.alias("s"), across.alias("x"))), shifted), 0)

    def shifted(t: Column) -> Column:
        s, x = t["s"], t["x"]
        more = s["down"].bitwiseOR(F.bitwise_not(x.bitwiseOR(s["up"])).bitwiseAND(every))
        less = s["up"].bitwiseAND(x)
        return F.get(F.transform(F.array(F.struct(s.alias("s"), more.alias("more"), less.alias("less"))), settled), 0)

    def settled(t: Column) -> Column:
        s, high = t["s"], lambda b: F.when(b.bitwiseAND(last) != 0, 1).otherwise(0)
        score = s["score"] + high(t["more"]) - high(t["less"])
        more, less = (F.shiftleft(t[b], 1).bitwiseAND(every) for b in ("more", "less"))
        both = s["eq"].bitwiseOR(s["down"])
        up = less.bitwiseOR(F.bitwise_not(both.bitwiseOR(more)).bitwiseAND(every))
        return F.struct(up.alias("up"), more.bitwiseAND(both).alias("down"), score.alias("score"), F.least(s["best"], score).alias("best"))

    first = F.struct(every.cast("long").alias("up"), zero.alias("down"), F.lit(m).alias("score"), F.lit(m).alias("best"))
    return F.aggregate(chars, first, step, lambda s: s["best"])


def fuzzy_distance(c: Column | str, needle: str) -> Column:
    """The least edit distance of the needle to a run of as many characters of the text, as a share of its length; case, accents and place do not matter."""
    c = fold_accents(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    n = len(needle)
    chars = F.split(c, "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.levenshtein(F.array_join(F.slice(chars, i, n), ""), fold_accents(F.lit(needle))))
    return F.array_min(runs) / F.lit(float(n))


def fuzzy_search(items: DataFrame, needle: str, weights: dict[str, float] | None = None, threshold: float = 0.4) -> DataFrame:
    """Items where some field is within the threshold, by the weighted mean of the fields' distances (own measure, of the kind that search boxes use).

    A run of any length is no farther than one of the needle's length, so one pass by nearest_run() rules most items out; the others are measured.
    """
    weights = weights or {"title": 0.5, "authors": 0.3, "keywords": 0.2}
    needle = needle.strip()
    if not needle:
        return items.limit(0).withColumn("score", F.lit(0.0))
    if len(needle) <= NEEDLE:
        items = items.where(F.least(*[nearest_run(c, needle) for c in weights], F.lit(NEEDLE)) <= threshold * len(needle) + 1e-9)
    far = {c: F.least(fuzzy_distance(c, needle), F.lit(1.0)) for c in weights}
    near = F.least(*far.values()) if len(far) > 1 else next(iter(far.values()))
    score = sum(far[c] * w for c, w in weights.items()) / sum(weights.values())
    return items.withColumns({"_near": near, "score": F.round(score, 6)}).where(F.col("_near") <= threshold).drop("_near")


def occurrences(pages: DataFrame, needle: str, text: str = "text") -> DataFrame:
    """Every place of the needle in the text, any case, overlapping ones too: char_start, char_end, match.

    The text is split before each place, so places follow from the pieces' lengths in one pass.
    """
    needle = needle.strip()
    lowered, n = F.lower(F.col(text)), len(needle)
    rows = pages.where(F.contains(lowered, F.lit(needle.lower()))) if needle else pages.limit(0)
    pieces = F.transform(F.split(lowered, f"(?={re.escape(needle.lower())})", -1), F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out")), lambda s: s["out"])
    places = F.when(F.startswith(lowered, F.lit(needle.lower())), F.concat(F.array(F.lit(0)), ends)).otherwise(ends)
    others = [c for c in pages.columns if c != text]
    found = rows.select(*others, text, F.explode(places).alias("char_start"))
    return found.select(*others, "char_start", (F.col("char_start") + n).alias("char_end"), F.substr(F.col(text), F.col("char_start") + 1, F.lit(n)).alias("match"))


def search_messages(messages: DataFrame, needle: str, session: str | None = None, k: int = 50) -> DataFrame:
    """The newest k messages that contain the needle, any case; none for an empty needle."""
    out = messages.where(F.contains(F.lower("text"), F.lit(needle.lower()))) if needle.strip() else messages.limit(0)
    if session is not None:
        out = out.where(F.col("conv_id") == session)
    return out.orderBy(F.desc("turn"), "conv_id").limit(k)


def sessions(messages: DataFrame, title_size: int = 40) -> DataFrame:
    """(conv_id, title, n_messages, last_turn): a session is called after its first user message."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    rows = messages.groupBy("conv_id").agg(first.alias("_first"), F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last_turn"))
    return rows.select("conv_id", F.replace(F.substring(F.coalesce("_first", F.lit("")), 1, title_size), F.lit("\n"), F.lit(" ")).alias("title"), "n_messages", "last_turn")


def search_sessions(listed: DataFrame, needle: str) -> DataFrame:
    return listed.where(F.contains(F.lower("title"), F.lit(needle.lower()))) if needle.strip() else listed.limit(0)


def search_conversations(messages: DataFrame, needle: str, k: int = 50) -> DataFrame:
    """Sessions by title and messages by content in one result, told apart by ``kind``."""
    a = search_sessions(sessions(messages), needle).select(F.lit("session").alias("kind"), "conv_id", F.lit(None).cast("long").alias("turn"), F.col("title").alias("text"))
    return a.unionByName(search_messages(messages, needle, None, k).select(F.lit("message").alias("kind"), "conv_id", "turn", "text"))


def validated(items: DataFrame) -> DataFrame:
    """Records with defaults where values are missing or blank; those without an id go."""
    blank = lambda c, d: F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit(d))
    return items.where(strip(F.coalesce("item_id", F.lit(""))) != "").withColumns({"title": blank("title", "未命名论文"), "authors": blank("authors", ""), "status": blank("status", "pending")})


def documents(files: DataFrame, tombstones: DataFrame, parsed: DataFrame, suffixes: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """(paper_id, files, is_deleted, has_parsed) of the stored files with a known suffix."""
    from folioflow.functions.text import suffix

    named = files.where(suffix("path").isin(*suffixes)).groupBy("paper_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    gone = tombstones.select("paper_id", F.lit(True).alias("_gone")).distinct()
    done = parsed.select("paper_id", F.lit(True).alias("_done")).distinct()
    return named.join(gone, "paper_id", "left").join(done, "paper_id", "left").select("paper_id", "files", F.coalesce("_gone", F.lit(False)).alias("is_deleted"), F.coalesce("_done", F.lit(False)).alias("has_parsed"))


def image_route(image_stem: Column, blocks: Column) -> Column:
    """What an image shows, by the first block (type, text, image) that tells: its own block's type, or a word in a block's text."""
    def tell(b: Column) -> Column:
        text = F.lower(F.coalesce(b["text"], F.lit("")))
        own = F.lower(F.regexp_extract(F.coalesce(b["image"], F.lit("")), r"([^/]*?)(?:\.[^./]*)?\z", 1)) == F.lower(image_stem)
        any_of = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(text, w))
        return (
            F.when(own & (b["type"] == "equation"), "formula_like").when(own & (b["type"] == "table"), "form_like")
            .when(any_of("图", "fig", "figure", "图表", "趋势", "对比"), "data_visualization")
            .when(any_of("架构", "流程", "框架", "结构", "diagram", "flowchart"), "technical_diagram")
            .when(any_of("公式", "equation", "formula"), "formula_like")
        )

    return F.coalesce(F.get(F.filter(F.transform(blocks, tell), lambda x: x.isNotNull()), F.lit(0)), F.lit("general_image"))


def document_route(scan: Column, formulas: Column, forms: Column, tables: Column, images: Column) -> Column:
    """A to E, by how much a document's pages ask of a parser."""
    return F.when(scan, "E").when(formulas & forms & images, "D").when(formulas | forms | tables, "C").when(images, "B").otherwise("A")


def probe(pages: DataFrame) -> DataFrame:
    """Features of documents from pages (paper_id, page, n_chars, formula_score, table_score, n_images, n_fields), and by them a route and how complex a document is.

    Scores are means over the first ten pages, and images are counted there; characters and form fields over all.
    """
    early = F.col("page") <= 10
    score = lambda c: F.coalesce(F.round(F.avg(F.when(early, F.least(c, F.lit(1.0)))), 9), F.lit(0.0))
    rows = pages.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.avg("n_chars").alias("density"), (F.sum("n_chars") > 100).alias("has_text"), score("formula_score").alias("formula"),
        score("table_score").alias("tables"), F.coalesce(F.sum(F.when(early, F.col("n_images"))), F.lit(0)).alias("images"), F.sum("n_fields").alias("fields"),
    )
    scan, formulas, tables = (F.col("density") < 50) & (F.col("n_pages") > 2), F.col("formula") > 0.1, F.col("tables") > 0.1
    forms, images = F.col("fields") > 0, F.col("images") > 0
    weight = sum(F.when(c, n).otherwise(0) for c, n in ((scan, 3), (formulas, 2), (tables, 1), (forms, 1), (images, 1)))
    complexity = F.when(weight >= 4, "complex").when(weight >= 2, "moderate").otherwise("simple")
    return rows.withColumns({"route": document_route(scan, formulas, forms, tables, images), "complexity": complexity})


def sections(chunks: DataFrame, paper: str = "paper_id", title: str = "section_title", blank: bool = False) -> DataFrame:
    """(paper, chunks, sections): how many chunks a paper has, and its distinct section titles in order; blank ones do not count unless ``blank``, nulls never do."""
    named = F.col(title) if blank else F.when(F.coalesce(F.col(title), F.lit("")) != "", F.col(title))
    per = chunks.groupBy(paper, named.alias("_t")).agg(F.count(F.lit(1)).alias("_n"))  # titles are made distinct before a paper's meet
    return per.groupBy(paper).agg(F.sum("_n").alias("chunks"), F.array_sort(F.collect_list("_t")).alias("sections"))


def page(items: DataFrame, order: Column, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order; each task keeps the first ``offset + limit`` of its rows, so no more are moved."""
    return items.orderBy(order, F.col(tie)).offset(offset).limit(limit)


#: A record's fields and the names under which they come, the first that has a value counts. Fixed values.
ALIASES = {"item_id": ("item_id", "library_item_id", "paper_id"), "title": ("title",), "authors": ("authors",), "kind": ("file_type", "kind"), "file_hash": ("file_hash",), "import_time": ("import_time",)}
COUNTS = {"pages": ("page_count", "total_pages"), "chunk_count": ("chunk_count",)}
STATUSES = ("ready", "failed")


def records(raw: DataFrame, column: str) -> DataFrame:
    """JSON objects as library records: each field by the first of its names with a value, blank strings and counts of 0 being none; a status that is not known is ``ready``.

    Fields are added to the row. Rows whose JSON is broken or that have no id are marked in ``rejected``, not lost.
    """
    names = [n for group in (*ALIASES.values(), *COUNTS.values(), ("status", "year")) for n in group]
    types = {n: "bigint" for n in (*COUNTS["pages"], *COUNTS["chunk_count"], "year")}
    r = F.from_json(column, ", ".join(f"{n} {types.get(n, 'string')}" for n in dict.fromkeys(names)) + ", keywords array<string>, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = raw.withColumn("_r", r)
    blank = lambda n: F.nullif(strip(F.col(f"_r.{n}")), F.lit(""))
    out = {k: F.coalesce(*map(blank, group), *([] if k == "item_id" else [F.lit("")])) for k, group in ALIASES.items()}
    out |= {k: F.coalesce(*[F.nullif(F.col(f"_r.{n}"), F.lit(0)) for n in group], F.lit(0)) for k, group in COUNTS.items()}
    out |= {"status": F.when(F.col("_r.status").isin(*STATUSES), F.col("_r.status")).otherwise("ready"), "year": F.col("_r.year")}
    out |= {"keywords": F.coalesce("_r.keywords", F.array().cast("array<string>"))}
    out |= {"rejected": F.when(F.col("_r").isNull() | F.col("_r._broken").isNotNull(), "broken").when(out["item_id"].isNull(), "no id")}
    return rows.withColumns(out).drop("_r")
