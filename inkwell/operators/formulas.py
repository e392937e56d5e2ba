"""Formula inventory and pagination."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Forms of formulas.
BLOCK = r"(?s)[$][$].+?[$][$]"
BRACKETS = r"(?s)\\{1,2}\[(.+?)\\{1,2}\]"
PARENTHESES = r"\\{1,2}\(([^\n\r\x{2028}\x{2029}]+?)\\{1,2}\)"
INLINE = r"[$][^ \t\n$](?:[^$\n]*[^ \t\n$])?[$]"


def formulas(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line, is_block, formula): blocks first found, inline ones only outside blocks, each with its line.

    Formulas are taken out of a part, with the line counted from the part's start, before the parts' line breaks are summed up: so of
    a text only its formulas are exchanged."""
    breaks = lambda x: F.length(x) - F.length(F.translate(x, "\n", ""))
    parts = docs.select("doc_id", F.posexplode(F.arrays_zip(F.split("text", BLOCK, -1).alias("part"), F.regexp_extract_all("text", F.lit(f"({BLOCK})"), F.lit(1)).alias("block"))).alias("k", "z"))
    parts = parts.select("doc_id", "k", F.col("z.part").alias("part"), F.col("z.block").alias("block"))
    none = F.array().cast("array<struct<at:int,is_block:boolean,formula:string>>")
    inner = lambda x, edge: x.substr(F.lit(edge + 1), F.length(x) - 2 * edge)
    found = lambda at, block, formula: F.struct(at.alias("at"), F.lit(block).alias("is_block"), formula.alias("formula"))
    of_line = lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(f"({INLINE})"), F.lit(1)), lambda m: found(i, False, inner(m, 1)))
    inline = F.flatten(F.transform(F.split("part", "\n", -1), lambda x, i: F.when(x.contains("$"), of_line(x, i)).otherwise(none)))
    own = F.when(F.col("block").isNotNull(), F.array(found(breaks(F.col("part")), True, inner(F.col("block"), 2)))).otherwise(none)
    n_breaks = breaks(F.col("part")) + F.coalesce(breaks(F.col("block")), F.lit(0))
    parts = parts.select("doc_id", "k", n_breaks.alias("breaks"), F.concat(F.when(F.col("part").contains("$"), inline).otherwise(none), own).alias("found"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", 1 + F.coalesce(F.sum("breaks").over(before), F.lit(0)))
    rows = parts.select("doc_id", "start", F.explode("found").alias("x"))
    return rows.select("doc_id", (F.col("start") + F.col("x.at")).alias("line"), "x.is_block", "x.formula")


def delimited(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, is_block, formula) of formulas between backslashed brackets, over several lines, and parentheses, within one; the
    backslash may stand twice."""
    found = [docs.select("doc_id", F.lit(block).alias("is_block"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("formula")) for block, pattern in ((True, BRACKETS), (False, PARENTHESES))]
    return found[0].unionByName(found[1])


def paginate(docs: DataFrame, height: int = 40, width: int = 80) -> DataFrame:
    """Rows (doc_id, page, first_line, last_line) of a fold over a document's lines: a line takes as many rows as its characters need,
    a heading doesn't end a page, and what doesn't fit starts the next one."""

    def pages(batches):
        for pdf in batches:
            out = []
            for doc, sizes, heads in zip(pdf["doc_id"], pdf["sizes"], pdf["heads"], strict=True):
                page, used, first = 1, 0, 0
                for i, size in enumerate(sizes):
                    want = size + (sizes[i + 1] if heads[i] and i + 1 < len(sizes) else 0)
                    if used and used + want > height:
                        out.append((doc, page, first + 1, i))
                        page, used, first = page + 1, 0, i
                    used += size
                out.append((doc, page, first + 1, len(sizes)))
            yield pd.DataFrame(out, columns=["doc_id", "page", "first_line", "last_line"])

    parts = F.split("text", "\n", -1)
    rows = docs.select("doc_id", F.transform(parts, lambda x: F.greatest(F.lit(1), F.ceil(F.length(x) / width)).cast("int")).alias("sizes"), F.transform(parts, lambda x: x.rlike("^#{1,6} ")).alias("heads"))
    return rows.mapInPandas(pages, "doc_id long, page int, first_line int, last_line int")
