import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import folds, rules, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column("t")).first()[0]


@pytest.mark.parametrize(("value", "tokens"), [("你好世界", 6), ("hello", 3), ("hello你好", 6), ("", 0), (None, 0)])
def test_tokens(spark, value, tokens):
    assert one(spark, text.estimate_tokens, value) == tokens


@pytest.mark.parametrize(
    ("step", "value", "want"),
    [
        (lambda c: text.substitute(c, [rules.CONTROL]), "hello\x00\x01\x02world", "helloworld"),
        (text.compress_newlines, "hello\n\n\n\n\n\n\n\nworld", "hello\n\nworld"),
        (lambda c: text.substitute(c, rules.GENERIC_REGEX_RULES), "a" * 100, "aaa"),
        (lambda c: text.substitute(c, rules.GENERIC_REGEX_RULES), "-" * 100, "-" * 100),
        (text.narrow_width, "１２３４５ＡｂＣ，。！？；：", "12345AbC，。！？；："),
        (text.join_cjk, "摘 要：本文 abc 测试", "摘要：本文 abc 测试"),
        (text.join_cjk_in_headings, "## 一 社会治理 维度\n正 文", "## 一社会治理维度\n正 文"),
        (text.join_spaced_headings, "# A B S T R A C T\nA B C", "# ABSTRACT\nA B C"),
        (lambda c: text.filter_lines(c, rules.ZH_LINE_RULES), "·社会学理论与实践研究·\n\n# 论文标题\n\n正文内容", "\n# 论文标题\n\n正文内容"),
        (lambda c: text.filter_lines(c, rules.ZH_LINE_RULES), "正文\n" * 25 + "·正文中的中点·", "正文\n" * 25 + "·正文中的中点·"),
        (lambda c: text.filter_lines(c, rules.ZH_LINE_RULES), "文献标志码：A\n\n文章编号：1\nISSN：1002-462X\n中图分类号：C91\n正文", "\n正文"),
        (lambda c: text.filter_lines(c, rules.EN_LINE_RULES), "© 2020 X\n12\nText 12\nOpen Access\n![](images/ab-1.png)\n", "Text 12\n"),
        (lambda c: text.substitute(c, [rules.HTML_TABLE_TAGS]), '<table class="x"><tr><td>a</td></tr></table>', "a"),
        (text.rstrip_lines, "a  \nb\t\n\n c ", "a\nb\n\n c"),
        (text.stem, "a/b/name.v2.pdf", "name.v2"),
        (text.suffix, "a/b/Name.PDF", ".pdf"),
        (text.repair_title, "0a1b2c3d_title", "title"),
        (text.pdf_year, "D:20210304", 2021),
        (text.pdf_year, "D:0001", None),
        (text.inline_markdown, "**a** *b* `c` <", "<strong>a</strong> <em>b</em> <code>c</code> &lt;"),
        (text.mask_secret, "sk-12345678", "****5678"),
    ],
)
def test_steps(spark, step, value, want):
    assert one(spark, step, value) == want


def test_line_filter_twice_is_once(spark):
    noisy = "© 2020 X\n目 录\n正文 内容\n12\n\nKeywords: a\n第1章 内容...... 3"
    both = rules.ZH_LINE_RULES + rules.EN_LINE_RULES
    once = one(spark, lambda c: text.filter_lines(c, both), noisy)
    assert once == "正文 内容\n" == one(spark, lambda c: text.filter_lines(c, both), once)


def test_page_ranges(spark):
    rows = spark.createDataFrame([(400,), (0,), (180,)], "n int").select(text.page_ranges("n")).collect()
    assert [r[0] for r in rows] == [["1-180", "181-360", "361-400"], [], ["1-180"]]


def test_toc():
    toc = "日求\n" + "\n".join(f"第{i}章内容" for i in range(1, 13))
    assert folds.drop_toc(toc + "\n## 前言\n正文") == "## 前言\n正文"
    short = "目录\n第1章\n## 前言"
    assert folds.drop_toc(short) == short
    lines = "\n".join(f"第{i}章内容" for i in range(1, 33))
    assert folds.drop_toc_blocks(lines + "\n\n正文", [{"type": "text", "text": lines, "page_idx": 0}]).strip() == "正文"
    assert folds.drop_toc_blocks(lines, [{"type": "text", "text": lines, "page_idx": 2}]) == lines


@pytest.mark.parametrize(
    ("fold", "value", "want"),
    [
        (folds.level_headings, "# Title\n### Skipped Level", "# Title\n## Skipped Level"),
        (folds.level_headings, "### a\n##### b\n# c", "### a\n#### b\n# c"),
        (folds.join_broken_lines, "ab\ncd\n\n# h\nlonger than ten", "abcd\n\n# h\nlonger than ten"),
        (folds.join_ultra_short_lines, "a\n\nb\n\n\nc", "ab\n\nc"),
        (folds.join_urls, "see https://a.b /c d", "see https://a.b/cd"),
        (folds.flatten_tables, "| a | b |\n|---|---|\n| 1 | 2 |\nx", "ab12\nx"),
        (folds.flatten_tables, "| a |\nx", "| a |\nx"),
    ],
)
def test_folds(fold, value, want):
    assert fold(value) == want


@given(st.text(alphabet="ab#| \n第章1", max_size=60))
def test_folds_settle(value):
    for fold in (folds.level_headings, folds.drop_toc):
        assert fold(fold(value)) == fold(value)


def test_labels(spark):
    row = spark.range(1).select(
        text.source_label(F.lit(""), F.lit(3), F.lit("s")).alias("a"), text.source_label(F.lit("t"), F.lit(0), F.lit(None).cast("string")).alias("b"),
        text.sanitize_title(F.lit("标题：好。再见"), F.lit("x")).alias("c"), text.snippet(F.lit("w " * 300)).alias("d"),
    ).first()
    assert row.a == "未命名论文｜第 3 页｜s" and row.b == "t" and row.c == "好"
    assert row.d.endswith("…") and len(row.d) <= 220
