"""Nested lists of any depth: levels, numbers that restart under each parent, and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, let
from .lines import blank, lines, so_far, with_fences

# List items, tasks, and the deepest level that a writer has.
ITEM = rf"^([ \t]*)([-*+]|[0-9]{{1,9}}[.)])[ \t]+(\[[ xX]\][ \t]+)?[^{WS}]"
DEEPEST = 4
#: Columns of a tab.
TAB = 4


def items(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, run, indent, kind): list lines outside fences; blank and indented lines don't part a run."""
    rows = with_fences(lines(docs), "ticks").withColumn("item", ~F.col("in_fence") & F.col("line").rlike(ITEM))
    ends = ~F.col("item") & ~blank(F.col("line")) & ~F.col("line").rlike("^[ \t]")
    rows = rows.withColumn("run", F.sum(ends.cast("int")).over(so_far())).where("item")
    lead = F.regexp_extract("line", ITEM, 1)
    kind = F.when(F.regexp_extract("line", ITEM, 3) != "", "task").when(F.regexp_extract("line", ITEM, 2).rlike("^[0-9]"), "ordered").otherwise("bullet")
    return rows.select("doc_id", "line_no", "run", (F.length(lead) + (TAB - 1) * F.regexp_count(lead, F.lit("\t"))).alias("indent"), kind.alias("kind"))


def nested_lists(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, depth, level, kind, number, marker, parent).

    An item's parent is the nearest one before it in its run that is indented less, null at the top; depth counts the ancestors and level stops at
    DEEPEST. Numbers count the items of one list: those with one parent, until ordered items follow others or the reverse. The fold
    over a run keeps the path to the last item, whose items that aren't indented less than the next one leave it."""
    rows = items(docs).groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "indent", "kind"))).alias("rows"))
    path = "array<struct<indent:int,ordered:boolean,number:int,line_no:int>>"
    out = "array<struct<line_no:int,depth:int,kind:string,number:int,parent:int>>"
    start = F.struct(F.array().cast(path).alias("path"), F.array().cast(out).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(acc.path, lambda s: s.indent < x.indent)
        ordered = x.kind == "ordered"

        def placed(above: Column) -> Column:
            # the first that leaves the path has the same parent
            sibling, parent = F.get(acc.path, F.size(above)), F.get(above, F.size(above) - 1)
            number = F.when(sibling.ordered == ordered, sibling.number + 1).otherwise(1)
            own = F.struct(x.indent.alias("indent"), ordered.alias("ordered"), number.alias("number"), x.line_no.alias("line_no"))
            row = F.struct(x.line_no.alias("line_no"), F.size(above).alias("depth"), x.kind.alias("kind"), number.alias("number"), parent.line_no.alias("parent"))
            return F.struct(F.concat(above, F.array(own)).alias("path"), F.concat(acc.out, F.array(row)).alias("out"))

        return let(above, placed)

    found = rows.select("doc_id", F.explode(F.aggregate("rows", start, step, lambda acc: acc.out)).alias("x")).select("doc_id", "x.*")
    marker = F.when(F.col("kind") == "ordered", F.concat(F.col("number").cast("string"), F.lit("."))).when(F.col("kind") == "bullet", "•").otherwise("")
    return found.select("doc_id", "line_no", "depth", F.least("depth", F.lit(DEEPEST)).alias("level"), "kind", "number", marker.alias("marker"), "parent")
