"""Whole texts made ready for a word processor: formulas, diagrams and characters, each of which may be left out.

The rules write the relation of lines that formatting.py describes, with ``fixes``, what was done to a line, in the place of the last rule. Which lines
are in fences and formulas is told anew before each rule. A text whose bytes were misread is decoded first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE, NBSP, WIDE, clean, count, trim, trim_start, without_code
from .documents import convert_delimiters
from .formatting import in_order, of_document, to_here
from .lines import MARKERS, lines
from .structured import readings
from .wordfix import ARROW, DIAGRAM, LINEAR, NO_DIAGRAM, as_formulas, marked_environments, without_formulas

#: Lines that a report names for each kind of fix.
EXAMPLES = 3


def with_context(rows: DataFrame) -> DataFrame:
    """Adds in_fence and active: outside fences and formula blocks."""
    rows = rows.withColumn("marker", F.col("line").rlike(MARKERS["ticks_or_tildes"]))
    rows = rows.withColumn("in_fence", F.col("marker") | (F.sum(F.col("marker").cast("int")).over(to_here()) % 2 == 1))
    rows = rows.withColumn("delims", F.when(F.col("in_fence"), 0).otherwise(count(without_code(F.col("line")), "[$][$]")))
    inside = (F.sum("delims").over(to_here()) % 2 == 1) & (F.col("delims") == 0)
    return rows.withColumn("active", ~F.col("in_fence") & ~inside)


def relation(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "line_no", "sub", "line", "fixes")


def noted(*labels: tuple[str, Column]) -> Column:
    """The fixes so far and those of the labels whose condition holds."""
    new = F.filter(F.array(*(F.when(F.coalesce(condition, F.lit(False)), label) for label, condition in labels)), lambda x: x.isNotNull())
    return F.concat("fixes", new)


def around(rows: DataFrame, label: str, before: Column, after: Column) -> DataFrame:
    """Puts lines before and behind; the fix is noted at the line that the first goes before."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn("before", before).withColumn("after", after).withColumn("fixes", noted((label, F.col("before").isNotNull())))
    place = lambda n, line, fixes: F.struct((F.col("sub") * 4 + n).alias("sub"), line.alias("line"), fixes.alias("fixes"))
    each = F.array(place(-1, F.col("before"), none), place(0, F.col("line"), F.col("fixes")), place(1, F.col("after"), none))
    rows = rows.select("doc_id", "line_no", F.explode(F.filter(each, lambda x: x.line.isNotNull())).alias("x"))
    return rows.select("doc_id", "line_no", "x.sub", "x.line", "x.fixes")


def with_delimiters(rows: DataFrame) -> DataFrame:
    rows = with_context(rows)
    line = F.col("line")
    round_ = ~F.col("in_fence") & line.contains("\\(") & line.contains("\\)")
    square = ~F.col("in_fence") & ((line.contains("\\[") & line.contains("\\]")) | trim(line).isin("\\[", "\\]"))
    rows = rows.withColumn("fixes", noted(("inline delimiters", round_), ("block delimiters", square)))
    return relation(rows.withColumn("line", F.when(F.col("in_fence"), line).otherwise(convert_delimiters(line))))


def with_linear(rows: DataFrame) -> DataFrame:
    rows = with_context(rows).withColumn("bare", F.when(F.col("active") & F.col("line").rlike(LINEAR), without_formulas(F.col("line"))))
    rows = rows.withColumn("new", F.when(F.col("bare").rlike(LINEAR), as_formulas()))
    changed = F.col("new") != F.col("line")
    return relation(rows.withColumn("fixes", noted(("linear formula", changed))).withColumn("line", F.coalesce("new", "line")))


def with_environments(rows: DataFrame) -> DataFrame:
    """Formula delimiters around bare environments. No rule before this one puts lines in, so line_no tells the lines apart."""
    rows = marked_environments(with_context(rows))
    rows = rows.withColumn("lasts", F.collect_list("last_line").over(of_document()))
    rows = rows.withColumn("opens", F.when(F.col("last_line").isNotNull(), "$$")).withColumn("closes", F.when(F.array_contains("lasts", F.col("line_no")), "$$"))
    return around(rows.drop("lasts"), "bare environment", F.col("opens"), F.col("closes"))


def with_diagrams(rows: DataFrame) -> DataFrame:
    """Fences around runs of diagram lines, as wordfix.diagrams() has it."""
    rows = with_context(rows).withColumn("head", trim(F.col("line")).rlike(DIAGRAM)).withColumn("arrow", F.col("line").rlike(ARROW))
    drawn = ~F.col("in_fence") & ~trim_start(F.col("line")).rlike(NO_DIAGRAM) & (F.col("head") | F.col("arrow"))
    rows = rows.withColumn("drawn", drawn).withColumn("k", F.row_number().over(in_order()))
    rows = rows.withColumn("run", F.when(F.col("drawn"), F.sum((~F.col("drawn")).cast("int")).over(to_here())))
    run = Window.partitionBy("doc_id", "run")
    rows = rows.withColumn("start", F.min("k").over(run)).withColumn("end", F.max("k").over(run)).withColumn("arrows", F.count_if("arrow").over(run)).withColumn("named", F.min(F.when(F.col("head"), F.col("k"))).over(run))
    whole = (F.col("end") - F.col("start") >= 2) & (F.col("arrows") >= 2)
    first = F.when(F.col("run").isNull(), None).when(whole, F.col("start")).when(F.col("named") < F.col("end"), F.col("named"))
    rows = rows.withColumn("first", first)
    return around(rows, "diagram", F.when(F.col("k") == F.col("first"), "```mermaid"), F.when(F.col("first").isNotNull() & (F.col("k") == F.col("end")), "```"))


def with_clean_characters(rows: DataFrame) -> DataFrame:
    rows = with_context(rows)
    has = lambda pattern: ~F.col("in_fence") & F.col("line").rlike(pattern)
    rows = rows.withColumn("fixes", noted(("invisible characters", has(f"[{INVISIBLE}]")), ("no-break spaces", has(NBSP)), ("wide letters", has(f"[{WIDE}]"))))
    return relation(rows.withColumn("line", F.when(F.col("in_fence"), F.col("line")).otherwise(clean(F.col("line")))))


def fixed_lines(docs: DataFrame, math: bool = True, chart: bool = True, structure: bool = True) -> DataFrame:
    rows = lines(docs).select("doc_id", "line_no", F.lit(0).alias("sub"), "line", F.array().cast("array<string>").alias("fixes"))
    if math:
        rows = with_environments(with_linear(with_delimiters(rows)))
    if chart:
        rows = with_diagrams(rows)
    return with_clean_characters(rows) if structure else rows


def fixed(docs: DataFrame, math: bool = True, chart: bool = True, structure: bool = True) -> DataFrame:
    """Rows (doc_id, text, report): the fixed text, and for each kind of fix (label, n, lines), by label: how many lines it was made on and
    the first of them by their numbers in the text as it came. Null stays null. Ids are told apart by doc_id."""
    rows = fixed_lines(docs, math, chart, structure)
    place = F.struct("line_no", "sub", "line")
    notes = F.array_sort(F.flatten(F.collect_list(F.transform("fixes", lambda x: F.struct(x.alias("label"), F.col("line_no").alias("line"))))))
    made = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda s: s.line), "\n").alias("text"), notes.alias("notes"))
    of = lambda label: F.transform(F.filter("notes", lambda x: x.label == label), lambda x: x.line)
    labels = F.array_distinct(F.transform("notes", lambda x: x.label))
    report = F.transform(labels, lambda label: F.struct(label.alias("label"), F.size(of(label)).alias("n"), F.slice(of(label), 1, EXAMPLES).alias("lines")))
    made = made.select("doc_id", "text", report.alias("report"))
    return made.unionByName(docs.where("text IS NULL").select("doc_id", "text", F.array().cast(made.schema["report"].dataType).alias("report")))


def deep_fixed(docs: DataFrame, suspicious: Column) -> DataFrame:
    """The same with the first recommended reading of the texts that ``suspicious`` picks: doc_id, text, reading (null: as it came), report."""
    best = readings(docs, suspicious).where("recommended AND rank = 1").select("doc_id", F.col("reading").alias("read"), F.col("name").alias("reading"))
    rows = docs.join(best, "doc_id", "left").select("doc_id", F.coalesce("read", "text").alias("text"), "reading")
    return fixed(rows).join(rows.select("doc_id", "reading"), "doc_id").select("doc_id", "text", "reading", "report")
