"""Features of pages from their texts, before any parser has seen them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import strip

# The marks of formulas and tables.
FORMULA_SYMBOLS = "∑∫√≤≥×÷αβγδεζηθικλμνξπρστυφχψω∂∇∞≈≠≡∈∉⊂⊃∪∩"
FORMULA_LATEX = r"\\(?:frac|sum|int|sqrt|lim|log|sin|cos|tan|alpha|beta|gamma|delta|lambda|pi|sigma)"
FORMULA_WORDS = r"(?:公式|式|Equation|Eq)\s*[\(（]?\d+[\)）]?"
TABLE_WORDS = r"(?:表|Table|Tab)\s*\d+"


def page_text(html: Column | str) -> Column:
    """A page's text with its lines and columns: cells end in tabs, rows and blocks in new lines; scripts, styles and comments go."""
    c = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    c = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)</t[dh]>", "\t")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|tr|li|div|h[1-6]|title|article|section|nav|footer|header)>", "\n")
    return F.regexp_replace(c, r"(?s)<[^>]*>", "")


def _times(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def page_features(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_chars, formula_score and table_score (0 to 1) to pages; a null or empty text scores 0.

    Formulas tell by the share of symbols, traces of LaTeX and numbered equations; tables by numbered captions and lines with tabs.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    symbols = (F.length(c) - F.length(F.translate(c, FORMULA_SYMBOLS, ""))) / F.greatest(F.length(c), F.lit(1))
    formula = symbols * 10 + _times(c, FORMULA_LATEX) * 0.2 + _times(c, f"(?iuU){FORMULA_WORDS}") * 0.1
    lines = F.split(c, "\n", -1)
    aligned = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("\t")) & (strip(x) != ""))) / F.size(lines)
    tables = _times(c, f"(?iuU){TABLE_WORDS}") * 0.2 + aligned * 0.5
    return pages.withColumns({"n_chars": F.length(strip(c)), "formula_score": F.least(formula, F.lit(1.0)), "table_score": F.least(tables, F.lit(1.0))})
