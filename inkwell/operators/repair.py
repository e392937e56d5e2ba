"""Repair of broken Markdown, line by line and by runs of table rows; all state comes from the original lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, count, let, trim, trim_end, trim_start, without_code
from .lines import is_marker, island_of_kept, lines, so_far, with_fences

#: What makes a line with an odd dollar a formula rather than a price.
MATH_SIGNAL = r"\\frac|\\int|\\sum|\\sqrt|\\times|\\left|\\right|\\begin\{|\\end\{|\\alpha|\\beta|\\gamma|\\delta|\\pi|\\mu|\\lambda|\\omega|\^|_"
#: The inline rules in their order.
RULES = ["heading_space", "inline_code", "bold", "math"]
HEADING = f"^([{WS}]*#{{1,6}})([^#{WS}].*)\\z"
SEPARATOR = f"^[{WS}|:-]+\\z"


def open_dollars(x: Column) -> Column:
    return count(x, r"\$") - count(x, r"\\\$")


def repair_inline(docs: DataFrame, kept: Column | None = None) -> DataFrame:
    """Lines with ``fixed`` and one flag per rule: heading_space, inline_code, bold, math. Fenced lines and lines inside a formula block
    stay. Also in_fence and ``delims``, the formula delimiters that count. Where only some lines are wanted (``kept``), others than those and
    the ones their state comes from are left out before the windows."""
    rows = lines(docs)
    if kept is not None:
        rows = rows.where(kept | F.col("line").contains("$") | is_marker("ticks_or_tildes"))
    rows = with_fences(rows, "ticks_or_tildes")
    rows = rows.withColumn("delims", F.when(F.col("in_fence"), 0).otherwise(count(without_code(F.col("line")), r"\$\$")))
    inside = (F.sum("delims").over(so_far()) % 2 == 1) & (F.col("delims") == 0)
    rows = rows.withColumn("active", ~F.col("in_fence") & ~inside)
    active = F.col("active")

    def step(x: Column, name: str, odd: Callable[[Column], Column], end: str) -> Column:
        """x.t with ``end`` behind it where ``odd`` holds, and that as a flag."""
        return let(x, lambda s: let(active & odd(s.t), lambda b: F.struct(F.when(b, F.concat(s.t, F.lit(end))).otherwise(s.t).alias("t"), *(s[k].alias(k) for k in RULES[: RULES.index(name)]), b.alias(name))))

    fix = let(active & F.col("line").rlike(HEADING), lambda b: F.struct(F.when(b, F.regexp_replace("line", HEADING, "$1 $2")).otherwise(F.col("line")).alias("t"), b.alias("heading_space")))
    fix = step(fix, "inline_code", lambda t: count(t, "`") % 2 == 1, "`")
    fix = step(fix, "bold", lambda t: count(without_code(t), r"\*\*") % 2 == 1, "**")
    fix = step(fix, "math", lambda t: let(F.regexp_replace(without_code(t), r"\$\$[^$]*\$\$", ""), lambda m: (open_dollars(m) % 2 == 1) & m.rlike(MATH_SIGNAL)), "$")
    rows = rows.withColumn("fix", fix)
    return rows.select("doc_id", "line_no", "line", "marker", "in_fence", "delims", F.col("fix.t").alias("fixed"), *(F.col(f"fix.{k}").alias(k) for k in RULES))


def cells(x: Column) -> Column:
    t = trim(x)
    return count(t, r"\|") - F.when(t.endswith("|"), 1).otherwise(0)


def repair_tables(rows: DataFrame, line: str = "fixed") -> DataFrame:
    """Adds ``table_fixed`` and flags last_pipe and missing_cells. Runs of table and separator lines are islands, in fences too; a
    run counts as a table with a separator and a content line, or with two content lines. The header is the last content line before the
    first separator, else the first content line."""
    t = trim(F.col(line))
    separator = t.startswith("|") & (F.length(t) >= 3) & t.rlike(SEPARATOR)
    content = t.startswith("|") & (F.length(t) >= 2) & ~t.rlike(SEPARATOR)
    rows = rows.withColumn("sep", separator).withColumn("content", content)
    rows = rows.withColumn("run", F.when(F.col("sep") | F.col("content"), island_of_kept(F.col("sep") | F.col("content"))))
    whole = Window.partitionBy("doc_id", "run")
    rows = rows.withColumn("first_sep", F.min(F.when(F.col("sep"), F.col("line_no"))).over(whole)).withColumn("n_content", F.sum(F.col("content").cast("int")).over(whole))
    header = F.coalesce(F.max(F.when(F.col("content") & (F.col("line_no") < F.col("first_sep")), F.col("line_no"))).over(whole), F.min(F.when(F.col("content"), F.col("line_no"))).over(whole))
    rows = rows.withColumn("header", header).withColumn("width", F.max(F.when(F.col("line_no") == F.col("header"), cells(F.col(line)))).over(whole))
    acts = F.col("content") & F.when(F.col("first_sep").isNotNull(), F.col("n_content") >= 1).otherwise(F.col("n_content") >= 2) & F.col("run").isNotNull()
    cut = trim_end(F.col(line))
    rows = rows.withColumn("last_pipe", acts & ~cut.endswith("|"))
    closed = F.when(F.col("last_pipe"), F.concat(cut, F.lit(" |"))).otherwise(cut)
    short = F.col("width") - cells(closed)
    rows = rows.withColumn("missing_cells", acts & (short > 0))
    changed = F.when(F.col("missing_cells"), F.concat(closed, F.repeat(F.lit(" |"), short.cast("int")))).otherwise(closed)
    return rows.withColumn("table_fixed", F.when(F.col("last_pipe") | F.col("missing_cells"), changed).otherwise(F.col(line))).drop("sep", "content", "first_sep", "n_content", "header", "width")


def repaired_rows(docs: DataFrame) -> DataFrame:
    """The table rows that repair_tables() mends. The inline rules don't change how a line starts, so lines that don't start as a table row
    are none afterwards."""
    rows = repair_tables(repair_inline(docs, trim_start(F.col("line")).startswith("|")))
    return rows.where("last_pipe OR missing_cells")


def repair(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text (repaired), the number of fixes by rule, open_math and open_fence."""
    rows = repair_tables(repair_inline(docs))
    rules = [*RULES, "last_pipe", "missing_cells"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col("table_fixed").alias("x")))), lambda s: s.x), "\n")
    out = rows.groupBy("doc_id").agg(text.alias("text"), *(F.count_if(r).alias(r) for r in rules), (F.sum("delims") % 2 == 1).alias("open_math"), (F.count_if("marker") % 2 == 1).alias("open_fence"))
    return out.withColumn("text", F.concat("text", F.when(F.col("open_math"), "\n$$").otherwise(""), F.when(F.col("open_fence"), "\n```").otherwise("")))


def fix_report(rows: DataFrame, rules: list[str]) -> DataFrame:
    """Per document and rule: how often, and the first three lines."""
    flat = rows.select("doc_id", "line_no", F.explode(F.array(*(F.when(F.col(r), F.lit(r)) for r in rules))).alias("rule")).where("rule IS NOT NULL")
    return flat.groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("line_no")), 1, 3), ",").alias("examples"))


