"""Numbering and page arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import HEADING_LINE
from .lines import lines, with_fences

#: Paper sizes in twentieths of a point.
PAPER = {"a4": (11906, 16838), "letter": (12240, 15840)}
WIDE_CHARS = "[ᄀ-ᇿ⺀-꓏豈-﫿＀-￯]"


def heading_numbers(docs: DataFrame) -> DataFrame:
    """Numbers 1, 1.1, 1.1.1 of the headings of levels 1 to 3: each counter restarts under a new parent."""
    rows = with_fences(lines(docs), "ticks").where(~F.col("in_fence") & F.col("line").rlike(HEADING_LINE))
    rows = rows.withColumn("level", F.length(F.regexp_extract("line", "^(#+)", 1))).where("level <= 3")
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("h1", F.sum((F.col("level") == 1).cast("int")).over(so_far))
    in1 = Window.partitionBy("doc_id", "h1").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("h2", F.sum((F.col("level") == 2).cast("int")).over(in1))
    in2 = Window.partitionBy("doc_id", "h1", "h2").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("h3", F.sum((F.col("level") == 3).cast("int")).over(in2))
    text = lambda c: F.col(c).cast("string")
    return rows.select("doc_id", "line_no", "level", F.when(F.col("level") == 1, text("h1")).when(F.col("level") == 2, F.concat_ws(".", text("h1"), text("h2"))).otherwise(F.concat_ws(".", text("h1"), text("h2"), text("h3"))).alias("number"))


def split_count(total: Column, fit: Column) -> Column:
    """Lines of a block that stay on the page: none alone here, none alone there."""
    k = F.least(fit, total)
    short = F.when((total - k == 1) & (k > 1), k - 1).otherwise(k)
    return F.when((total <= 0) | (fit <= 0), 0).when(k >= total, k).when((short == 1) & (total > 1), 0).otherwise(short)


def toc_pages(entries: Column, height: float) -> Column:
    return F.greatest(F.lit(1), F.ceil((70 + 30 * entries) / F.lit(height)))


def display_width(x: Column) -> Column:
    """Wide characters count twice."""
    return F.length(x) + F.regexp_count(x, F.lit(WIDE_CHARS))


def column_balance(cells: DataFrame) -> DataFrame:
    """Column widths in percent from the widest cell of each column (80 units at most) with a floor of half the mean; what is over 100
    comes off the columns above the floor in proportion. cells: table_id, col, text."""
    weights = cells.groupBy("table_id", "col").agg(F.max(F.least(display_width(F.col("text")), F.lit(80))).alias("w"))
    t = Window.partitionBy("table_id")
    rows = weights.withColumn("floor", 50.0 / F.count("*").over(t)).withColumn("p", F.greatest(100.0 * F.col("w") / F.sum("w").over(t), F.col("floor")))
    rows = rows.withColumn("over", F.sum("p").over(t) - 100).withColumn("surplus", F.sum(F.col("p") - F.col("floor")).over(t))
    cut = F.when(F.col("over") <= 1e-9, F.col("p")).when(F.col("surplus") > F.col("over"), F.col("floor") + (F.col("p") - F.col("floor")) * (F.col("surplus") - F.col("over")) / F.col("surplus")).otherwise(F.col("p") * 100 / (F.col("over") + 100))
    return rows.select("table_id", "col", F.round(cut, 2).alias("pct"))
