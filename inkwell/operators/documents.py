"""Validation, statistics and per-document analytics of Markdown texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, count, trim
from .lines import lines, with_fences

# The patterns that define the counts. They hold for Java and RE2 alike.
EMPTY_HEADING = f"^#{{1,6}}[{WS}]*\\z"
HEADING_LINE = f"^#{{1,6}}[{WS}]+[^{WS}]"
STAT_HEADING = f"(?m)^#{{1,6}}[{WS}]+[^{WS}]"
STAT_FENCE = "(?m)^```"
STAT_ROW = r"(?m)^[|][^\n]+[|][ \t]*$"
STAT_SEPARATOR = r"(?m)^[|][ \t|:-]+[|][ \t]*$"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
LIVE_MATH = r"(?:^|[^\\$])[$][^$\n]+?[$]"
HEALTH_MATH = r"(?s)[$][$].*?[$][$]|\\\[.*?\\\]|[$][^$\n]+[$]"
PAGEBREAK = r"(?im)^[ \t]*<!--\s*pagebreak\s*-->[ \t]*$"
PAGE_MARKS = [rf"(?im)^[ \t]*[{c}]{{3,}}[ \t]*page[ \t]+#?[0-9]+(?:[ \t]*[{c}]{{3,}})?[ \t]*$" for c in ("=", "-", "~", "_")]
PAGE_MARK = "(?im)" + "|".join(p.removeprefix("(?im)") for p in PAGE_MARKS)
PDF_MARK = r"(?im)^[ \t]*[=]{3,}[ \t]*page[ \t]+[0-9]+[ \t]*[=]{3,}[ \t]*$"
ESCAPED_BOLD = r"\\[*]\\[*]([^*\n]{1,300}?)\\[*]\\[*]"
ESCAPED_TABLE = rf"(?i)&lt;(table|tr|td)([{WS}]|&gt;)"
REPLACED = "�"
LATIN_CJK = "[æðþý][\x80-\xbf]|ç[\x80-\xbf]{2}"
#: Code points that read well: CJK and its punctuation, full-width, printable Latin, punctuation, kana, Hangul, arrows, shapes.
SOUND = "[\u4e00-\u9fff\u3400-\u4dbf\u3000-\u303f\uff00-\uffef -~\u00a0-\u00ff\u2000-\u206f\u2100-\u214f\u3040-\u30ff\uac00-\ud7af\u2190-\u21ff\u25a0-\u25ff]"
ASTRAL = "[𐀀-􏿿]"
LINEAR = r"▒|_\(|\^\("
INLINE_MATH = r"[$][^$\n ][^$\n]*[$]"
CAPTION_BOTH = [rf"(?i)^[ \t]*{m}[ \t]*(图|表|figure|table|fig[.]?)[ \t]*[0-9]*[ \t]*[:：][ \t]*([^\n]*?)[ \t]*{m}[ \t]*\z" for m in ("[*]", "_")]


def validate(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line, rule, level): open_fence and open_math at the last such line, empty_heading and inline_code per line."""
    all_ = with_fences(lines(docs), "ticks")
    starts = all_.where(F.col("line").startswith("```")).groupBy("doc_id").agg(F.max("line_no").alias("line"), F.count("*").alias("n")).where("n % 2 = 1")
    outside = all_.where("NOT in_fence")
    tokens = outside.withColumn("n", count(F.col("line"), r"\$\$")).where("n > 0").groupBy("doc_id").agg(F.max("line_no").alias("line"), F.sum("n").alias("n")).where("n % 2 = 1")
    row = lambda df, line, rule, level: df.select("doc_id", F.col(line).alias("line"), F.lit(rule).alias("rule"), F.lit(level).alias("level"))
    return (
        row(starts, "line", "open_fence", "error")
        .unionByName(row(tokens, "line", "open_math", "error"))
        .unionByName(row(all_.where(F.col("line").rlike(EMPTY_HEADING)), "line_no", "empty_heading", "warn"))
        .unionByName(row(outside.where(count(F.col("line"), "`") % 2 == 1), "line_no", "inline_code", "warn"))
    )


def stats(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", count(t, STAT_HEADING).alias("headings"), (count(t, STAT_ROW) - count(t, STAT_SEPARATOR)).alias("table_rows"), count(t, IMAGE).alias("images"), F.floor(count(t, STAT_FENCE) / 2).alias("code_blocks"), count(t, PAGEBREAK).alias("pagebreaks"), F.length(t).alias("chars"))


def live_stats(docs: DataFrame) -> DataFrame:
    """Characters that aren't blank, formulas (blocks first), tables by their separator lines, images, estimated pages."""
    t = F.col("text")
    chars = F.length(F.regexp_replace(t, f"[{WS}]", ""))
    block = "(?s)[$][$].+?[$][$]"
    separators = F.size(F.filter(F.split(t, "\n", -1), lambda x: x.contains("|") & x.contains("-") & trim(x).rlike(f"^[{WS}|:+-]+\\z")))
    return docs.select("doc_id", chars.alias("chars"), (count(t, block) + count(F.regexp_replace(t, block, ""), LIVE_MATH)).alias("math"), separators.alias("tables"), count(t, IMAGE).alias("images"), F.when(chars > 0, F.greatest(F.lit(1), F.ceil(chars / 900))).alias("pages"))


def feature_counts(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", count(t, HEALTH_MATH).alias("math"), F.when(count(t, STAT_ROW) >= 2, 1).otherwise(0).alias("tables"), F.floor(count(t, STAT_FENCE) / 2).alias("code_blocks"), count(t, IMAGE).alias("images"))


def heading_jumps(docs: DataFrame) -> DataFrame:
    """Headings outside fences that are more than one level below the heading before."""
    rows = with_fences(lines(docs), "ticks").where(~F.col("in_fence") & F.col("line").rlike(HEADING_LINE))
    rows = rows.withColumn("level", F.length(F.regexp_extract("line", "^(#+)", 1))).withColumn("before", F.lag("level").over(Window.partitionBy("doc_id").orderBy("line_no")))
    return rows.where("level > before + 1").select("doc_id", "line_no", "before", "level")


def quality(docs: DataFrame) -> DataFrame:
    """Share of sound code points in the UTF-16 length."""
    valid, units = count(F.col("text"), SOUND), F.length("text") + count(F.col("text"), ASTRAL)
    return docs.select("doc_id", valid.alias("valid"), units.alias("units"), F.round(valid / F.nullif(units, F.lit(0)), 6).alias("quality"))


def mojibake(docs: DataFrame) -> DataFrame:
    """Texts with more than 3 replacement characters (and the line of the first) or more than 5 misread CJK sequences."""
    rows = docs.select("doc_id", "text", count(F.col("text"), REPLACED).alias("replaced"), count(F.col("text"), LATIN_CJK).alias("latin")).where("replaced > 3 OR latin > 5")
    before = F.substring("text", F.lit(1), F.instr("text", REPLACED) - 1)
    return rows.select("doc_id", "replaced", "latin", F.when(F.col("replaced") > 3, F.size(F.split(before, "\n", -1))).alias("replaced_line"), (F.col("latin") > 5).alias("is_latin"))


def source_warnings(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", t.rlike(PDF_MARK).alias("pdf_marks"), t.rlike(ESCAPED_BOLD).alias("escaped_bold"), t.rlike(ESCAPED_TABLE).alias("escaped_table")).where("pdf_marks OR escaped_bold OR escaped_table")


def captions(docs: DataFrame) -> DataFrame:
    """Caption lines with their kind, text and number within the document and kind."""
    found = F.coalesce(*(F.when(F.col("line").rlike(p), F.struct(F.regexp_extract("line", p, 1).alias("word"), F.regexp_extract("line", p, 2).alias("text"))) for p in CAPTION_BOTH))
    rows = lines(docs, state=False).withColumn("c", found).where("c IS NOT NULL")
    rows = rows.select("doc_id", "line_no", F.when(F.col("c.word").rlike("(?i)^(图|fig)"), "fig").otherwise("tbl").alias("kind"), trim(F.col("c.text")).alias("text"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("line_no")))


def convert_delimiters(x: Column) -> Column:
    r"""\(..\) to $..$ and \[..\] to $$..$$ on a line that has both; a lone \[ or \] line to $$."""
    inline = F.when(x.contains("\\(") & x.contains("\\)"), F.replace(F.replace(x, F.lit("\\("), F.lit("$")), F.lit("\\)"), F.lit("$"))).otherwise(x)
    pair = F.replace(F.replace(inline, F.lit("\\["), F.lit("$$")), F.lit("\\]"), F.lit("$$"))
    return F.when(inline.contains("\\[") & inline.contains("\\]"), pair).when(trim(inline).isin("\\[", "\\]"), "$$").otherwise(inline)
