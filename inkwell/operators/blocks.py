"""Blocks of documents and their layout decisions, health of extractions, selections and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, WS, trim, trim_start
from .documents import HEADING_LINE, IMAGE
from .lines import blank, island, lines, so_far, with_fences
from .structure import BULLET, ORDERED, SEPARATOR_ROW, TABLE_ROW, UNORDERED, prefix_type

# Kinds of lines in order, limits of the checks, sizes.
REFERENCES = f"(?i)^#{{1,6}}[{WS}]+(参考文献|references|bibliography)[{WS}]*\\z"
EXTERNAL_IMAGE = r"(?i)!\[[^\]]*\]\(https?://[^)]+\)"
MEDIA = r"(?i)<(video|audio|iframe)[ >]"
MAX_CHARS, MAX_COLUMNS = 150_000, 9
IMAGE_WIDTH, DEFAULT_SIZE = 600, (400, 300)
LIST_LINE = f"^([{WS}]*)([-*+]|[0-9]+[.])[{WS}]+"


def kind(line: Column, in_fence: Column) -> Column:
    return (
        F.when(in_fence, "code").when(blank(line), "blank").when(line.rlike(HEADING_LINE), "heading").when(line.rlike(SEPARATOR_ROW) & line.contains("|"), "separator").when(line.rlike(TABLE_ROW), "table")
        .when(line.rlike(ORDERED), "ordered").when(line.rlike(UNORDERED) | line.rlike(BULLET), "bullet").when(trim_start(line).startswith(">"), "quote").when(line.rlike(rf"^[{WS}]*{IMAGE}[{WS}]*\z"), "image")
        .when(trim(line).startswith("$$"), "math").when(line.rlike(f"^[{WS}]*(-{{3,}}|[*]{{3,}}|_{{3,}})[{WS}]*\\z"), "rule").otherwise("paragraph")
    )


def blocks(docs: DataFrame) -> DataFrame:
    """Runs of lines of one kind: doc_id, first_line, kind, n. Headings, rules and images stand alone; blank lines only part."""
    rows = with_fences(lines(docs), "ticks").withColumn("kind", kind(F.col("line"), F.col("in_fence")))
    before = F.lag("kind").over(Window.partitionBy("doc_id").orderBy("line_no"))
    new = F.coalesce(before != F.col("kind"), F.lit(True)) | F.col("kind").isin("heading", "rule", "image")
    rows = rows.withColumn("new", new).withColumn("block", F.sum(F.col("new").cast("int")).over(so_far())).where("kind <> 'blank'")
    return rows.groupBy("doc_id", "block", "kind").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n")).drop("block")


def reference_sections(docs: DataFrame) -> DataFrame:
    """Lines from the first heading of a reference section on: doc_id, from_line, n."""
    rows = with_fences(lines(docs), "ticks")
    flag = F.max((~F.col("in_fence") & F.col("line").rlike(REFERENCES)).cast("int")).over(so_far())
    return rows.withColumn("in_refs", flag).where("in_refs = 1").groupBy("doc_id").agg(F.min("line_no").alias("from_line"), F.count("*").alias("n"))


def list_numbers(docs: DataFrame) -> DataFrame:
    """Numbers of list lines in their run: level 0 counts through, deeper lines restart under each of them."""
    rows = with_fences(lines(docs), "ticks").withColumn("item", ~F.col("in_fence") & (F.col("line").rlike(LIST_LINE) | F.col("line").rlike(BULLET)))
    rows = rows.withColumn("run", F.when(F.col("item"), island(F.col("item")))).where("item")
    rows = rows.withColumn("level", F.when(F.length("line") - F.length(trim_start(F.col("line"))) >= 2, 1).otherwise(0))
    in_run = Window.partitionBy("doc_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("top", F.sum((F.col("level") == 0).cast("int")).over(in_run))
    under = Window.partitionBy("doc_id", "run", "top").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("sub", F.sum("level").over(under)).select("doc_id", "line_no", "level", F.when(F.col("level") == 0, F.col("top")).otherwise(F.col("sub")).alias("number"))


def heading_groups(docs: DataFrame) -> DataFrame:
    """Lines with a heading prefix in groups of one prefix type (blank lines don't part them); a group with a long line is a list."""
    rows = with_fences(lines(docs), "ticks").where(~F.col("in_fence") & ~blank(F.col("line"))).withColumn("type", prefix_type(trim_start(F.col("line")))["type"])
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("new", (~F.col("type").eqNullSafe(F.lag("type").over(w))).cast("int")).withColumn("grp", F.sum("new").over(w)).where("type IS NOT NULL")
    long = (F.length(trim_start(F.col("line"))) > 100) | F.col("line").rlike("[。！？]")
    return rows.groupBy("doc_id", "grp", "type").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"), F.when(F.max(long), "list").otherwise("heading").alias("verdict")).drop("grp")


def stranded_headings(docs: DataFrame) -> DataFrame:
    """Headings whose next line with text is a heading too, or that end the document."""
    rows = with_fences(lines(docs), "ticks").where(~blank(F.col("line"))).withColumn("heading", ~F.col("in_fence") & F.col("line").rlike(HEADING_LINE))
    after = F.lead("heading").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.withColumn("after", F.coalesce(after, F.lit(True))).where("heading AND after").select("doc_id", "line_no")


def limits(docs: DataFrame) -> DataFrame:
    """Export checks: external images, media that isn't supported, size, widest table."""
    pipes = F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(TABLE_ROW)), lambda x: F.length(x) - F.length(F.translate(x, "|", "")) - 1)
    rows = docs.select("doc_id", F.regexp_count("text", F.lit(EXTERNAL_IMAGE)).alias("external_images"), F.regexp_count("text", F.lit(MEDIA)).alias("media"), (F.length("text") > MAX_CHARS).alias("oversize"), F.coalesce(F.array_max(pipes), F.lit(0)).alias("widest"))
    return rows.withColumn("wide_table", F.col("widest") >= MAX_COLUMNS)


def confidence(rows: DataFrame) -> DataFrame:
    """high: all groups found first; low: a group missing or nothing found; medium: fallbacks. rows: id, messages, misses, fallbacks."""
    return rows.withColumn("confidence", F.when((F.col("messages") == 0) | (F.col("misses") > 0), "low").when(F.col("fallbacks") > 0, "medium").otherwise("high"))


def regressions(rows: DataFrame, least: int = 5) -> DataFrame:
    """Visits with no message though the host's last visit with messages had ``least`` or more. rows: host, at, messages."""
    w = Window.partitionBy("host").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("messages") > 0, F.col("messages")), ignorenulls=True).over(w)
    return rows.withColumn("before", before).where((F.col("messages") == 0) & (F.col("before") >= least))


def script_runs(texts: DataFrame) -> DataFrame:
    """Runs of CJK and of other characters of each text: id, place, run."""
    return texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(f"([{CJK}]+|[^{CJK}]+)"), F.lit(1))).alias("place", "run"))


def image_size(width: Column, height: Column) -> list[Column]:
    """Width and height of a placed image: a default without a size, scaled down to the text's width."""
    w, h = F.when(width > 0, width).otherwise(DEFAULT_SIZE[0]), F.when((width > 0) & (height > 0), height).otherwise(DEFAULT_SIZE[1])
    return [F.least(w, F.lit(IMAGE_WIDTH)), F.when(w > IMAGE_WIDTH, F.floor(h * IMAGE_WIDTH / w + 0.5)).otherwise(h)]


def zip_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides matched by place, for documents where both have as many; others have no row. Both: doc_id, ord, value."""
    n = Window.partitionBy("doc_id")
    a = left.withColumn("n", F.count("*").over(n)).select("doc_id", "ord", F.col("value").alias("a"), "n")
    b = right.withColumn("n", F.count("*").over(n)).select("doc_id", "ord", F.col("value").alias("b"), "n")
    return a.join(b, ["doc_id", "ord", "n"]).select("doc_id", "ord", "a", "b")


def match_once(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal values matched one to one in order (each candidate is used once): doc_id, value, l, r. Both: doc_id, ord, value."""
    w = Window.partitionBy("doc_id", "value").orderBy("ord")
    a = left.withColumn("k", F.row_number().over(w)).select("doc_id", "value", "k", F.col("ord").alias("l"))
    b = right.withColumn("k", F.row_number().over(w)).select("doc_id", "value", "k", F.col("ord").alias("r"))
    return a.join(b, ["doc_id", "value", "k"]).drop("k")


