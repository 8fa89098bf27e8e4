"""Column expressions for text: token estimates, cleaning steps, names, snippets. All run in the JVM.

Python's white space, digits and word characters are Unicode, so patterns carry (?U); its ``$`` and
Java's agree on a final newline.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\x{4E00}-\\x{9FFF}"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+\z", "")


def cjk_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(c), f"[^{CJK}]", ""))


def estimate_tokens(c: Column | str) -> Column:
    """1.5 for a CJK character, 0.75 for any other, rounded down; 0 for null."""
    c = F.coalesce(_c(c), F.lit(""))
    return F.floor((F.length(c) + cjk_count(c)) * 0.75).cast("long")


def cjk_ratio(c: Column | str) -> Column:
    c = F.coalesce(_c(c), F.lit(""))
    return F.when(F.length(c) > 0, cjk_count(c) / F.length(c)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class LineRule:
    """Lines that any pattern finds (or, if ``full``, matches as a whole) go; ``limit``: among the first so many lines only."""

    name: str
    patterns: tuple[str, ...]
    limit: int | None = None
    full: bool = False

    def hits(self, line: Column, at: Column) -> Column:
        joined = "|".join(f"(?:{p})" for p in self.patterns)
        hit = line.rlike(f"\\A(?:{joined})\\z" if self.full else joined)
        return hit if self.limit is None else hit & (at < self.limit)


@dataclass(frozen=True)
class RegexRule:
    name: str
    pattern: str
    replacement: str = ""


def filter_lines(c: Column | str, rules: list[LineRule]) -> Column:
    """The text without the lines that a rule hits; blank lines stay."""

    def keep(line: Column, at: Column) -> Column:
        s = strip(line)
        return (s == "") | ~reduce(lambda a, b: a | b, [r.hits(s, at) for r in rules])

    return F.array_join(F.filter(F.split(_c(c), "\n", -1), keep), "\n")


def removed_lines(c: Column | str, rules: list[LineRule]) -> Column:
    return F.size(F.split(_c(c), "\n", -1)) - F.size(F.split(filter_lines(c, rules), "\n", -1))


def substitute(c: Column | str, rules: list[RegexRule]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r.pattern, r.replacement), rules, _c(c))


def substitutions(c: Column | str, rules: list[RegexRule]) -> Column:
    """How many substitutions each rule makes, by name, in the order of the rules."""
    t, counts = _c(c), []
    for r in rules:
        counts += [F.lit(r.name), F.regexp_count(t, F.lit(r.pattern))]
        t = F.regexp_replace(t, r.pattern, r.replacement)
    return F.create_map(*counts)


def normalize_newlines(c: Column | str) -> Column:
    """Line ends of other systems as plain ones."""
    return F.regexp_replace(_c(c), r"\r\n?", "\n")


def compress_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "\n{3,}", "\n\n")


def rstrip_lines(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)[^\S\n]+(?=\n|\z)", "")


def narrow_width(c: Column | str) -> Column:
    """Full-width digits and letters as ASCII ones; punctuation stays."""
    wide = [chr(0xFF00 + k - 0x20) for k in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))]
    plain = [chr(k) for k in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))]
    return F.translate(_c(c), "".join(wide), "".join(plain))


def join_cjk(c: Column | str) -> Column:
    """Without white space between two CJK characters."""
    return F.regexp_replace(_c(c), f"(?U)(?<=[{CJK}])\\s+(?=[{CJK}])", "")


def join_cjk_in_headings(c: Column | str) -> Column:
    def line(x: Column) -> Column:
        return F.when(x.rlike(r"(?U)\A#{1,6}\s+.+\z"), F.concat(F.regexp_extract(x, r"(?U)\A(#{1,6})\s+", 1), F.lit(" "), join_cjk(F.regexp_replace(x, r"(?U)\A#{1,6}\s+", "")))).otherwise(x)

    return F.array_join(F.transform(F.split(_c(c), "\n", -1), line), "\n")


def join_spaced_headings(c: Column | str) -> Column:
    """Headings written letter by letter: "# A B S T R A C T" as "# ABSTRACT"."""

    def line(x: Column) -> Column:
        title = F.regexp_extract(x, r"\A#{1,6}\s+([A-Za-z](?:\s+[A-Za-z]){2,})\s*\z", 1)
        return F.when(title != "", F.concat(F.regexp_extract(x, r"\A(#{1,6}\s+)", 1), F.replace(title, F.lit(" "), F.lit("")))).otherwise(x)

    return F.array_join(F.transform(F.split(_c(c), "\n", -1), line), "\n")


def first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def sanitize_title(c: Column | str, fallback: Column | str, longest: int = 20) -> Column:
    """One line without quotes, up to the first end of a sentence, without a leading title mark, cut to ``longest``; the fallback where nothing is left."""
    blank = lambda x: strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))
    t = F.regexp_replace(blank(c), "^[\"'`]+|[\"'`]+\\z", "")
    t = strip(F.regexp_extract(t, r"\A([^\n\r。！？.!?]*)", 1))
    t = F.regexp_replace(t, r"(?U)\A(标题|对话标题)\s*[:：]\s*", "")
    t = F.when(t == "", blank(fallback)).otherwise(t)
    return first_nonempty(strip(F.substring(t, 1, longest)), strip(F.substring(_c(fallback), 1, longest)), F.lit("新对话"))


def snippet(c: Column | str, longest: int = 220) -> Column:
    """White space as single blanks, cut to ``longest`` characters of which the last is then an ellipsis."""
    t = strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) > longest, F.concat(F.regexp_replace(F.substring(t, 1, longest - 1), r"(?U)\s+\z", ""), F.lit("…"))).otherwise(t)


def source_label(title: Column | str, page: Column | str, section: Column | str) -> Column:
    """Title, page and section joined by ｜; an untitled paper has a stand-in, pages below 1 and empty sections are left out."""
    page = _c(page)
    return F.concat_ws("｜", first_nonempty(_c(title), F.lit("未命名论文")), F.when(page > 0, F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))), F.nullif(_c(section), F.lit("")))


def paper_id(file_name: Column | str) -> Column:
    """The file name's stem; one of over 50 characters as its first 40 and 8 digits of its MD5."""
    s = stem(file_name)
    return F.when(F.length(s) > 50, F.concat(F.substring(s, 1, 40), F.lit("_"), F.substring(F.md5(s), 1, 8))).otherwise(s)


def stem(path: Column | str) -> Column:
    name = F.regexp_extract(_c(path), r"([^/\\]*)\z", 1)
    return F.when(name.rlike(r"(?s)\A.+\.[^.]*\z"), F.regexp_extract(name, r"(?s)\A(.+)\.[^.]*\z", 1)).otherwise(name)


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"[^/\\](\.[^./\\]+)\z", 1))


def repair_title(c: Column | str) -> Column:
    """Without the eight hexadecimal digits and underscore that uploads put before names."""
    return F.regexp_replace(_c(c), "^[0-9a-f]{8}_", "")


def session_title(c: Column | str, longest: int = 30) -> Column:
    return F.replace(F.substring(_c(c), 1, longest), F.lit("\n"), F.lit(" "))


def content_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(_c(c).cast("binary"), 256), 1, 16)


def mask_secret(c: Column | str) -> Column:
    c = F.coalesce(_c(c), F.lit(""))
    return F.when(c == "", "").when(F.length(c) <= 8, "****").otherwise(F.concat(F.lit("****"), F.right(c, F.lit(4))))


ACCENTED, UNACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys"


def fold_accents(c: Column | str) -> Column:
    """Lower case, Latin-1 letters without their accents."""
    return F.translate(F.lower(_c(c)), ACCENTED, UNACCENTED)


def escape_html(c: Column | str) -> Column:
    t = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def highlight(c: Column | str, needle: str) -> Column:
    """Escaped text in which every case-insensitive match of the needle is marked."""
    if not needle.strip():
        return escape_html(c)
    import re

    escaped = needle
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        escaped = escaped.replace(a, b)
    return F.regexp_replace(escape_html(c), f"(?iu)({re.escape(escaped)})", "<mark>$1</mark>")


def inline_markdown(c: Column | str) -> Column:
    """Bold, italic and code marks as HTML, after escaping."""
    t = escape_html(c)
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    t = F.regexp_replace(t, r"(?<!\*)\*([^*\n]+)\*(?!\*)", "<em>$1</em>")
    return F.regexp_replace(t, r"`([^`]+)`", "<code>$1</code>")


def pdf_year(c: Column | str) -> Column:
    """The year of a D:YYYY... date, between 1900 and 2100, or null."""
    year = F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"\A(?:D:)?(\d{4})", 1).try_cast("int")
    return F.when(year.between(1900, 2100), year)


def page_ranges(pages: Column | str, at_once: int = 180) -> Column:
    """"1-180", "181-360", ... up to the last page; none for no pages."""
    n = _c(pages)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(at_once))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.concat(s.cast("string"), F.lit("-"), F.least(s + at_once - 1, n).cast("string")))


def strip_tags(c: Column | str) -> Column:
    """An HTML page's text: scripts, styles and comments go, tags become blanks, white space single."""
    t = F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, "(?s)<[^>]*>", " "), r"\s+", " "))
