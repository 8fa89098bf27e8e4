"""Cleaning rules for papers. All patterns here are fixed values that decide which lines count as noise."""

from __future__ import annotations

from folioflow.functions.text import LineRule, RegexRule

ZH_COVER = (
    r"(?U)^分类号[：:]\s*\S+", r"(?U)^中图分类号[：:]\s*\S+", r"(?U)^单位代码[：:]\s*\S+", r"(?U)^密级[：:]\s*\S+", r"(?U)^学号[：:]\s*\S+", r"(?U)^UDC[：:]\s*\S+",
    r"(?U)^学校代码[：:]\s*\S+", r"(?U)^文献标志码[：:]\s*\S+", r"(?U)^文章编号[：:]\s*\S+", r"(?U)^ISSN[：:]\s*\S+", r"(?U)^收稿日期[：:]\s*\S+",
)
ZH_INSTITUTION = (
    "^培养单位", "^专业名称[：:.]", "^指导教师", "^合作导师[：:.]", "^一级学科[：:.]", "^二级学科[：:.]", "^研究方向[：:.]", r"(?U)^作者[：:]\s*\S+$", "^作者姓名",
    "^学位授予单位", "^申请学位", "^硕士学位论文$", "^博士学位论文$", "^学士学位论文$", r"(?U)^\d{4}年\d{1,2}月\d{1,2}日$", r"(?U)^\d{4}年\d{1,2}月$", "大学学位评定委员会$", "^东北师范大学.*研究生",
)
ZH_TOC = (
    r"(?U)^目\s*录\s*$", r"(?U)^\s*[\x{4E00}-\x{9FFF}\w].*[\.．…]{2,}\s*\d+\s*$", r"(?U)^\s*[\x{4E00}-\x{9FFF}\w].*\.\.\s*[\.\s]*\d+\s*$",
    r"(?U)^[\x{4E00}-\x{9FFF}\w].*\.\.\s*[\.\s]*\d+\s*$", r"(?U)^[\x{4E00}-\x{9FFF}\w].*\.\.\s*$",
)
ZH_LINE_RULES = [
    LineRule("zh_cover", ZH_COVER),
    LineRule("zh_institution", ZH_INSTITUTION),
    LineRule("zh_journal_header", (r"(?U)·.{2,40}·\s*",), limit=20, full=True),
    LineRule("zh_toc_entry", ZH_TOC),
]

EN_COVER = (
    r"^©\s*\d{4}", r"(?i)^Article history", r"(?U)^Received\s+\d{1,2}\s+\w+\s+\d{4}", r"(?U)^Accepted\s+\d{1,2}\s+\w+\s+\d{4}", "(?i)^Available online", r"(?i)^Keywords?\s*[:：]",
    r"^A\s+R\s+T\s+I\s+C\s+L\s+E\s+I\s+N\s+F\s+O", r"^A\s+B\s+S\s+T\s+R\s+A\s+C\s+T", "(?i)^Corresponding author", r"(?i)^E-mail\s*[:：]", r"(?U)^[A-Z][a-z]+ [A-Z][a-z]+\s+[\w.]+@[\w.]+\.\w+$",
)
EN_INSTITUTION = (
    "(?i)^Research Supervisor", "(?i)^Candidate[：:.]", "(?i)^College[：:.]", "(?i)^Specialty[：:.]", "(?i)^Supervisor[：:.]",
    "(?i)^Dissertation Submitted", "(?i)^Thesis for Master", "(?i)^Dissertation for Doctor", "(?i)University.*Degree",
)
EN_HEADER_FOOTER = (
    "(?i)^Check for updates$", r"(?i)^Publisher'?s?\s+note", "(?i)^Contents lists? available", "(?i)^journal homepage", r"(?i)^doi\s*:\s*10\.", r"(?U)^\d+\s*$",
    r"(?i)^ORIGINAL\s+PAPER$", r"(?i)^Original\s+article$", r"(?i)^REVIEWED\s+BY$", r"(?i)^OPEN\s+ACCESS$", r"(?i)^Index\s+\d+\s*$",
)
EN_JOURNAL_PAGE = (
    "(?i)^Submit your article to this journal", "(?i)^View (?:related )?articles", "(?i)^View Crossmark data", r"(?i)^Article views?:\s*\d+",
    r"(?i)^Citing articles?:\s*\d+", "(?i)^This page intentionally left blank", r"(?i)^This article was submitted to\b",
)
EN_COPYRIGHT = (
    r"(?i)^Copyright[:\s].*(?:Licensee|Publisher|Published by)", r"(?i)^©?\s*The Author\(s\)\s+\d{4}", "(?i)^Disclaimer/Publisher", r"(?i)^\(c\)\s*\d{4}\s+.*(?:Published by|Licensee)",
)
EN_LINE_RULES = [
    LineRule("en_cover", EN_COVER),
    LineRule("en_institution", EN_INSTITUTION),
    LineRule("en_header_footer", EN_HEADER_FOOTER),
    LineRule("en_journal_page", EN_JOURNAL_PAGE),
    LineRule("en_copyright", EN_COPYRIGHT),
    LineRule("bare_image", (r"(?i)^!\[\]\(images?/[a-f0-9\-]+\.(?:jpg|jpeg|png|gif|bmp|webp)\)\s*$",)),
    LineRule("table_placeholder", (r"(?i)^\[Insert\s+Table\s+\d+.*?\]$",)),
    LineRule("en_toc_entry", ("(?i)^Table of Contents", r"(?i)^CONTENTS\s*$")),
]

PAGE_FOOTER = RegexRule("zh_page_footer", r"(?mU)^第\s*\d+\s*页\s*共\s*\d+\s*页\s*$")
ZH_REGEX_RULES = [PAGE_FOOTER, RegexRule("watermark", "(?m)^.*中国知网.*cnki.*$"), RegexRule("author_note", "(?m)作者简介[：:].*$")]
HTML_TABLE_TAGS = RegexRule("html_table_tags", r"(?i)</?(?:table|tr|td|th|thead|tbody)\b[^>]*>")
CONTROL = RegexRule("control", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
PRIVATE_USE = RegexRule("private_use", "[\\x{E000}-\\x{F8FF}]")
REPEATED = RegexRule("repeated", r"(?U)([^\s\-\.=\*|_~#])\1{50,}", "$1$1$1")
GENERIC_REGEX_RULES = [PRIVATE_USE, CONTROL, RegexRule("garble", r"[\x00-\x08\x0e-\x1f]{3,}"), PAGE_FOOTER, REPEATED]

#: What begins a chapter line, and a numbered line, in a table of contents; and its title as scans have it.
TOC_CHAPTER = r"第[一二三四五六七八九十百千\d]+[篇章节部]"
TOC_NUMBERED = r"[一二三四五六七八九十]+[、.]"
TOC_TITLE = r"[日目]\s*[求录]\s*"
