"""Structure inference on plain text: noise lines, repeated headers, re-joined paragraphs, headings, lists, tables, typography."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, INVISIBLE, NARROW, WIDE, WIDE_CLASS, WS, count, is_ascii, trim, trim_end, trim_start
from .lines import blank, dealt, is_marker, island, lines, so_far, with_fences

# The patterns of the rules, in forms that Java and RE2 read alike.
PAGE_NUMBER = rf"(?i)^[{WS}]*-?[{WS}]*(page)?[{WS}]*[0-9]+[{WS}]*(of[{WS}]*[0-9]+)?[{WS}]*-?[{WS}]*\z"
PAGE_NUMBER_CJK = rf"(?i)^[{WS}–—=_*·•-]*(第[{WS}]*[0-9]+[{WS}]*页([{WS}]*[,，/／共][{WS}]*(共[{WS}]*)?[0-9]+[{WS}]*页?)?|共[{WS}]*[0-9]+[{WS}]*页|page[{WS}]*[0-9]+[{WS}]*[/／ofx×][{WS}]*[0-9]+)[{WS}]*\z"
LETTER = f"[{CJK}a-zA-Z]"
STARTER = "^[#>*|+-]"
TABLE_ROW = rf"^[{WS}]*[|][^\n]*\z"
SEPARATOR_ROW = rf"^[{WS}]*[|]?[{WS}:|-]*-[{WS}:|-]*\z"
ORDERED = f"^[{WS}]*[0-9]+[.][{WS}]+"
UNORDERED = f"^[{WS}]*[-*+][{WS}]+"
BULLET = f"^([{WS}]*)[•·Ø*‣▪◦●○►➢‒–][{WS}]+"
BOX_DONE = rf"^([{WS}]*)(\[x\]|\[X\]|☑|✓|✔)([{WS}]+|\z)"
BOX_OPEN = rf"^([{WS}]*)(\[ \]|☐|□|✗|✘)([{WS}]+|\z)"
QUOTE = r"(?i)^(注意|提示|警告|重要|备注|风险|安全|示例|说明|摘要|note|tip|warning|caution|important|example)[:：][ \t]*"
REFERENCE = r"^(\[[0-9]+\])[ \t]*"
CAPS = r"^[A-Z][A-Z0-9 \t&,'.-]{2,59}\z"
#: Lines of a table drawn with borders.
GRID_BORDER = rf"^[{WS}]*[+][-=]{{2,}}[+]([-=]{{2,}}[+])+[{WS}]*\z"
GRID_CONTENT = rf"^[{WS}]*[|].*[|][{WS}]*\z"
#: Heading prefixes in order: pattern, level, type.
PREFIXES = [
    ("^第[一二三四五六七八九十百千万0-9]+[章节篇部分]", 2, "chap"),
    (r"(?i)^section[ \t]+[0-9]+([.][0-9]+)?", 3, "ensec"),
    (r"(?i)^subsection[ \t]+[0-9]+([.][0-9]+)?", 2, "ensec"),
    (r"(?i)^(chapter|part)[ \t]+[0-9]+", 2, "ensec"),
    ("^[一二三四五六七八九十]+、", 3, "zh"),
    (rf"^[IVX]{{1,6}}[.][ \t]+[A-Z{CJK}]", 3, "roman"),
    (r"^[0-9]+[.][0-9]+[.][0-9]+([ \t]+|\z)", 4, "dot3"),
    (r"^[0-9]+[.][0-9]+([ \t]+|\z)", 3, "dot2"),
    (rf"^[0-9]+[.][{CJK}（「【]", 2, "dot1"),
    (r"^[0-9]+[.]([ \t]+|\z)", 2, "dot1"),
    (r"^(\([0-9]+\)|[0-9]+\)|（[一二三四五六七八九十0-9]+）|\([一二三四五六七八九十0-9]+\))", 0, "bracket"),
]
# Section names that are headings as a whole line, without blanks and final colon, in lower case.
KEYWORDS = [
    "摘要", "abstract", "关键词", "keywords", "目录", "contents", "引言", "绪论", "前言", "背景", "研究背景", "问题提出", "问题重述",
    "相关工作", "文献综述", "理论基础", "研究方法", "方法", "材料与方法", "方法与材料", "实验", "实验设计", "实验结果", "结果", "结果与分析", "结果与讨论",
    "分析", "讨论", "模型构建", "数据来源", "评价指标", "结论", "研究结论", "总结", "结论与展望", "总结与展望", "展望", "局限与展望", "研究局限", "政策建议",
    "对策建议", "结语", "参考文献", "references", "bibliography", "致谢", "acknowledgments", "acknowledgements", "附录",
    "appendix",
]
APPENDIX = "(?i)^(附录|appendix|appendices)([A-Za-z0-9]{1,4})\\z"
#: A line with no more characters, blanks aside, than the longest section name and a colon; on a longer one the pattern ends early.
SHORT = rf"^[{WS}]*+(?:[^{WS}][{WS}]*+){{0,{max(map(len, KEYWORDS)) + 1}}}+\z"


def is_page_number(x: Column) -> Column:
    return x.rlike(PAGE_NUMBER) | x.rlike(PAGE_NUMBER_CJK)


def page_number_noise(docs: DataFrame) -> DataFrame:
    return with_fences(lines(docs), "ticks").where(~F.col("in_fence") & is_page_number(F.col("line"))).select("doc_id", "line_no", "line")


#: Lines of a text that may have running headers.
MIN_LINES = 30


def repeated_headers(docs: DataFrame) -> DataFrame:
    """Lines to drop as running headers: outside fences, 2 to 60 characters with a letter, three times or more in the text; only in texts of
    30 lines and 10 distinct ones, if at most 15 % of the lines that aren't blank would go and some stay."""
    # a text of fewer lines has none to drop
    docs = dealt(docs).where(F.size(F.split("text", "\n", MIN_LINES)) >= MIN_LINES)
    rows = with_fences(lines(docs, state=False), "ticks").withColumn("noise", ~F.col("in_fence") & is_page_number(F.col("line"))).where("NOT noise")
    rows = rows.withColumn("t", trim(F.col("line")))
    candidate = ~F.col("in_fence") & F.length("t").between(2, 60) & F.col("t").rlike(LETTER)
    rows = rows.withColumn("times", F.sum(candidate.cast("int")).over(Window.partitionBy("doc_id", "t")))
    rows = rows.withColumn("drop", candidate & (F.col("times") >= 3) & ~F.col("t").rlike(STARTER))
    doc = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("t") != "").alias("solid"), F.countDistinct(F.when(F.col("t") != "", F.col("t"))).alias("kinds"), F.count_if("drop").alias("drops"))
    doc = doc.where(f"n >= {MIN_LINES} AND kinds >= 10 AND drops > 0 AND drops < solid AND 100 * drops <= 15 * solid").select("doc_id")
    return rows.where("drop").join(doc, "doc_id", "left_semi").select("doc_id", "line_no", "t")


def paragraph_rejoin(docs: DataFrame) -> DataFrame:
    """Wrapped lines joined to paragraphs, simplified to local boundaries: a line goes on the one before unless either is blank, in a fence or a
    starter, or the one before ends a sentence. CJK joins directly, a broken word without its hyphen, others with a space."""
    rows = with_fences(lines(docs), "ticks")
    rows = rows.withColumn("t", F.when(F.col("in_fence"), F.col("line")).otherwise(trim(F.col("line"))))
    rows = rows.withColumn("fixed_line", F.col("in_fence") | (F.col("t") == "") | F.col("t").rlike(r"^[#>*|+=—―\[(（$\\<{}-]") | F.col("t").rlike(r"^[0-9]{1,3}[.、)）]"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.lag("t").over(w)
    starts = F.col("fixed_line") | F.coalesce(F.lag("fixed_line").over(w), F.lit(True)) | before.rlike(r"[。！？：；.!?:…]\z")
    glue = F.when(before.rlike(r"[a-zA-Z]{3}-\z") & F.col("t").rlike("^[a-z]"), "-").when(before.rlike(r"[a-zA-Z]-\z") & F.col("t").rlike("^[a-z]"), "").when(before.rlike(rf"[{CJK}，。、；：！？…）】》」』\]]\z") | F.col("t").rlike(f"^[{CJK}]"), "").otherwise(" ")
    rows = rows.withColumn("starts", starts).withColumn("glue", F.when(F.col("starts"), "").otherwise(glue))
    rows = rows.withColumn("nextglue", F.coalesce(F.lead("glue").over(w), F.lit(""))).withColumn("part", F.sum(F.col("starts").cast("int")).over(so_far()))
    piece = F.concat(F.when(F.col("glue") == " ", " ").otherwise(""), F.when(F.col("nextglue") == "-", F.regexp_replace("t", r"-\z", "")).otherwise(F.col("t")))
    grouped = rows.withColumn("piece", piece).groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda s: s.piece), "").alias("text"))
    return grouped.where("n > 1").select("doc_id", "part", "n", "text")


def blank_collapse(docs: DataFrame) -> DataFrame:
    """Blank lines outside fences right behind another: the ones that go."""
    rows = with_fences(lines(docs), "ticks").withColumn("gap", ~F.col("in_fence") & blank(F.col("line")))
    before = F.lag("gap").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.withColumn("before", F.coalesce(before, F.lit(False))).where("gap AND before").select("doc_id", "line_no")


def prefix_type(x: Column) -> Column:
    return reduce(lambda c, p: c.when(x.rlike(p[0]), F.struct(F.lit(p[1]).alias("level"), F.lit(p[2]).alias("type"))), PREFIXES, F)


def heading_prefixes(docs: DataFrame) -> DataFrame:
    rows = with_fences(lines(docs), "ticks").where("NOT in_fence").withColumn("h", prefix_type(trim_start(F.col("line"))))
    return rows.where("h IS NOT NULL").select("doc_id", "line_no", "h.level", "h.type")


def keyword_headings(docs: DataFrame) -> DataFrame:
    """Lines that are a section name as a whole, and the heading they become."""
    rows = with_fences(lines(docs).where(is_marker() | F.col("line").rlike(SHORT)), "ticks").where("NOT in_fence")
    bare = F.regexp_replace(F.regexp_replace("line", f"[:：][{WS}]*\\z", ""), f"[{WS}]+", "")
    rows = rows.withColumn("bare", bare)
    name = F.when(F.lower("bare").isin(*KEYWORDS), F.col("bare")).when(F.col("bare").rlike(APPENDIX), F.regexp_replace("bare", APPENDIX, "$1 $2"))
    return rows.withColumn("name", name).where("name IS NOT NULL").select("doc_id", "line_no", F.concat(F.lit("## "), "name").alias("heading"))


def caps_headings(docs: DataFrame) -> DataFrame:
    rows = with_fences(lines(docs), "ticks").where("NOT in_fence").withColumn("t", trim(F.col("line")))
    rows = rows.where(F.col("t").rlike(CAPS) & ((F.length("t") >= 6) | F.col("t").contains(" ")) & F.col("t").rlike("^.[^\n]*[A-Z]"))
    return rows.select("doc_id", "line_no", F.concat(F.lit("### "), "t").alias("heading"))


def columns(x: Column) -> Column:
    return F.filter(F.transform(F.split(trim(x), r"\t|[ \t]{2,}", -1), trim), lambda c: c != "")


def table_inference(docs: DataFrame) -> DataFrame:
    """Runs of two or more lines with two or more columns (parted by a tab or several blanks): the rows they become."""
    rows = with_fences(lines(docs), "ticks")
    plain = ~F.col("in_fence") & ~F.col("line").rlike(TABLE_ROW) & ~F.col("line").rlike(SEPARATOR_ROW) & ~F.col("line").rlike(ORDERED) & ~F.col("line").rlike(UNORDERED) & ~trim_start(F.col("line")).rlike("^(#|```|> |[0-9]+[.])")
    rows = rows.withColumn("cols", columns(F.col("line"))).withColumn("row", plain & (F.size("cols") > 1))
    rows = rows.withColumn("run", F.when(F.col("row"), island(F.col("row"))))
    w = Window.partitionBy("doc_id", "run")
    rows = rows.where("row").withColumn("n", F.count("*").over(w)).withColumn("first", F.col("line_no") == F.min("line_no").over(w)).where("n > 1")
    return rows.select("doc_id", "line_no", F.concat(F.lit("| "), F.array_join("cols", " | "), F.lit(" |")).alias("text"), F.when(F.col("first"), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("cols")))).alias("separator"))


def grid_tables(docs: DataFrame) -> DataFrame:
    """Tables drawn with borders: the pipe rows they become, short ones filled up, and the separator behind the first. A run of grid lines
    is a table if it has two rows or more and a border."""
    rows = with_fences(lines(docs), "ticks")
    rows = rows.withColumn("border", ~F.col("in_fence") & F.col("line").rlike(GRID_BORDER)).withColumn("content", ~F.col("in_fence") & F.col("line").rlike(GRID_CONTENT))
    rows = rows.withColumn("run", island(F.col("border") | F.col("content"))).where("border OR content")
    inner = F.regexp_replace(F.regexp_replace(trim(F.col("line")), "^[|]", ""), r"[|]\z", "")
    rows = rows.withColumn("cells", F.when(F.col("content"), F.transform(F.split(inner, "[|]", -1), trim)))
    w = Window.partitionBy("doc_id", "run")
    rows = rows.withColumn("n", F.count_if("content").over(w)).withColumn("whole", F.count("*").over(w)).withColumn("width", F.max(F.size("cells")).over(w)).withColumn("first", F.min(F.when(F.col("content"), F.col("line_no"))).over(w))
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    rows = rows.where("content AND n >= 2 AND n < whole")
    return rows.select("doc_id", "line_no", F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |")).alias("text"), F.when(F.col("line_no") == F.col("first"), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("width")))).alias("separator"))


def separator_injection(docs: DataFrame) -> DataFrame:
    """Runs of two or more pipe rows outside fences without a separator: the one to put behind the first."""
    rows = with_fences(lines(docs), "ticks").withColumn("row", ~F.col("in_fence") & F.col("line").rlike(TABLE_ROW))
    rows = rows.withColumn("run", F.when(F.col("row"), island(F.col("row")))).where("row")
    first = F.min_by("line", "line_no")
    runs = rows.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.count_if(F.col("line").rlike(SEPARATOR_ROW)).alias("seps"), first.alias("line")).where("n > 1 AND seps = 0")
    inner = F.regexp_replace(F.regexp_replace(trim(F.col("line")), "^[|]", ""), r"[|]\z", "")
    return runs.select("doc_id", "line_no", F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), count(inner, "[|]") + 1), "|"), F.lit("|")).alias("separator"))


def bullets(docs: DataFrame) -> DataFrame:
    """Task and bullet symbols as list items."""
    rows = with_fences(lines(docs), "ticks").where("NOT in_fence")
    x = F.col("line")
    new = F.when(x.rlike(BOX_DONE), F.regexp_replace(x, BOX_DONE, "$1- [x] ")).when(x.rlike(BOX_OPEN), F.regexp_replace(x, BOX_OPEN, "$1- [ ] ")).when(x.rlike(BULLET), F.regexp_replace(x, BULLET, "$1- "))
    return rows.withColumn("text", new).where("text IS NOT NULL").select("doc_id", "line_no", "text")


def callouts(docs: DataFrame) -> DataFrame:
    """Call-outs as quotes, numbered references with a bold marker."""
    rows = with_fences(lines(docs), "ticks").where("NOT in_fence").withColumn("t", trim_start(F.col("line")))
    new = F.when(F.col("t").rlike(QUOTE), F.regexp_replace("t", QUOTE, "> **$1**：")).when(F.col("t").rlike(REFERENCE), F.regexp_replace("t", REFERENCE, "**$1** "))
    return rows.withColumn("text", new).where("text IS NOT NULL").select("doc_id", "line_no", "text")


#: Narrow punctuation, its wide form, and the blanks behind it that go too, in order.
PUNCTUATION = ((",", "，", r"[ \t]*"), (".", "。", ""), (";", "；", ""), (":", "：", ""), ("?", "？", ""), ("!", "！", ""))
#: Inline code, links, images, tags and URLs, which stay as they are.
PROTECTED = rf"(`[^`]*`|!?\[[^\]]*\]\([^)]*\)|<[^>{WS}]+>|(?:https?://|www\.)[^{WS}<>\x22\x27{CJK}，。；：！？）】》」』、…—–·]+)"


def polish(x: Column) -> Column:
    """Typography of one segment: no invisible characters, narrow letters and digits, a space between CJK and Latin, wide punctuation
    behind a CJK character where another or the segment's end follows."""
    x = F.replace(F.translate(F.regexp_replace(x, f"[{INVISIBLE}]", ""), WIDE, NARROW), F.lit("　"), F.lit(" "))
    x = F.regexp_replace(F.regexp_replace(x, f"([{CJK}])([a-zA-Z0-9])", "$1 $2"), f"([a-zA-Z0-9])([{CJK}])", "$1 $2")
    x = F.regexp_replace(x, rf"([{CJK}])[ \t]+([，。！？；：、）】》」』\]])", "$1$2")
    x = F.regexp_replace(x, rf"([（【《「『])[ \t]+([{CJK}])", "$1$2")
    for narrow, wide, behind in PUNCTUATION:
        x = F.regexp_replace(x, rf"([{CJK}])[ \t]*[{narrow}]{behind}(?=[{CJK}]|\z)", f"$1{wide}")
    return x


def polished(line: Column) -> Column:
    """A line with its segments between protected spans polished; of blanks at its end two stay if there are two or more."""
    spans = F.regexp_extract_all(line, F.lit(PROTECTED), F.lit(0))
    parts = F.zip_with(F.transform(F.split(line, PROTECTED, -1), polish), spans, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.array_join(parts, ""), r"[ \t]{2,}\z", "  "), r"(^|[^ \t])[ \t]\z", "$1")


#: What a rule of polish() or the end of polished() begins with; a line without it stays as it is.
TOUCHED = rf"[{INVISIBLE}{WIDE_CLASS}　]|[{CJK}](?:[a-zA-Z0-9]|[ \t]*[,.;:?!]|[ \t]+[，。！？；：、）】》」』\]])|[a-zA-Z0-9（【《「『][ \t]*[{CJK}]|[ \t]\z"


def has_typography(line: Column) -> Column:
    """Lines with a character that the rules are about; none is ASCII."""
    beyond = line.rlike(r"[^\x00-\xac\xae-\xff]")  # a soft hyphen is the only one of them in Latin-1
    return ~is_ascii(line) & beyond & line.rlike(f"[{CJK}{INVISIBLE}{WIDE_CLASS}　]")


def typography(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    wanted = has_typography(line) & line.rlike(TOUCHED) & ~line.rlike(TABLE_ROW)
    rows = with_fences(lines(docs).where(is_marker() | wanted), "ticks").where(~F.col("in_fence"))
    # as an array the text is made once, not for the filter and again for the row
    rows = rows.select("doc_id", "line_no", "line", F.explode(F.array(polished(line))).alias("text"))
    return rows.where("text <> line").select("doc_id", "line_no", "text")
