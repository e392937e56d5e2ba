"""Page breaks of documents made of blocks: text, headings, figures with captions, tables with a repeated header, forced breaks.

A piece tells by numbers what must fit for it to be placed behind others. Pieces are dealt by document and placed in order; of the pages so
far only the one that is being filled is kept, so the work grows with the pieces and a task's memory does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most of the distance between two blocks.
GAP = 120
PAGES = pa.schema([(name, pa.int64()) for name in ("doc_id", "page", "first_block", "first_part", "last_block", "last_part", "n_parts")])


def pieces(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, block, idx, n, kind, h, need, gap, header, moved): lines, rows, and whole blocks.

    ``need`` is what must fit for the piece to be placed behind others: a heading needs the start of the next block, a figure its caption, a
    text's first line the second one and its last line but one the last."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    second = F.coalesce(F.get("sizes", F.lit(1)), F.lit(0))
    first = F.get("sizes", F.lit(0))
    table_start = F.when(F.col("header") > 0, F.col("header")).otherwise(first)
    total = F.aggregate("sizes", F.lit(0), lambda a, x: a + x) + F.when(F.col("kind") == "table", F.col("header")).otherwise(0)
    rows = blocks.withColumn("start", F.when(F.col("kind") == "break", 0).when(F.col("kind") == "text", first + second).when(F.col("kind") == "table", F.least(total, table_start + F.when(F.col("header") > 0, first).otherwise(second))).otherwise(total))
    rows = rows.withColumn("next_start", F.coalesce(F.lead("start").over(w), F.lit(0))).withColumn("next_kind", F.coalesce(F.lead("kind").over(w), F.lit("")))
    # a table's header is a piece of its own before its rows
    sizes = F.when((F.col("kind") == "table") & (F.col("header") > 0), F.concat(F.array(F.col("header")), F.col("sizes"))).otherwise(F.col("sizes"))
    rows = rows.withColumn("parts", F.when(F.col("kind") == "break", F.array(F.lit(0))).otherwise(sizes))
    # the kind of the block whose piece stands before
    before = F.last(F.when(F.size("parts") > 0, F.col("kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    # each part with the one after it, so that no row carries the whole list
    rows = rows.withColumn("n", F.size("parts")).withColumn("last", F.when(F.col("n") == 3, F.get("parts", F.lit(2))).otherwise(0))
    zipped = F.arrays_zip(F.col("parts").alias("h"), F.slice("parts", F.lit(2), F.greatest(F.col("n"), F.lit(0))).alias("after"))
    rows = rows.select("doc_id", "ord", "kind", "gap", "header", "next_start", "next_kind", "before", "n", "last", F.posexplode(zipped).alias("idx", "part"))
    rows = rows.withColumn("h", F.col("part.h")).withColumn("after", F.coalesce("part.after", F.lit(0))).drop("part")
    after = F.col("after")
    text = F.when(F.col("idx") == 0, F.col("h") + after + F.col("last")).when(F.col("idx") == F.col("n") - 2, F.col("h") + after).otherwise(F.col("h"))
    need = (
        F.when(F.col("kind") == "text", text)
        .when(F.col("kind") == "heading", F.col("h") + F.col("next_start"))
        .when((F.col("kind") == "figure") & (F.col("next_kind") == "caption"), F.col("h") + F.col("next_start"))
        .when((F.col("kind") == "break") | ((F.col("kind") == "table") & (F.col("idx") == 0) & (F.col("header") > 0)), 0)
        .otherwise(F.col("h"))
    )
    gap = F.when((F.col("idx") == 0) & (F.col("kind") != "break"), F.greatest(F.lit(0), F.least("gap", F.lit(GAP)))).otherwise(0)
    rows = rows.withColumn("need", need).withColumn("before", F.when(F.col("idx") == 0, F.col("before")).otherwise(F.col("kind")))
    # no distance behind a forced break, nor between a figure and its caption
    pair = (F.col("kind") == "caption") & (F.col("before") == "figure")
    rows = rows.withColumn("space", F.when(F.coalesce((F.col("before") == "break") | pair, F.lit(False)), 0).otherwise(gap))
    # a text that a page starts with because it didn't fit behind others is placed line by line, like the rest of one that a page cuts
    rows = rows.withColumn("moved", F.coalesce(F.col("before") != "break", F.lit(False)))
    return rows.select("doc_id", F.col("ord").alias("block"), "idx", "n", "kind", "h", "need", F.col("space").alias("gap"), "header", "moved")


def placed(parts: DataFrame, height: int) -> DataFrame:
    """The pages of pieces() as pages() gives them; a document's pieces are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = page = used = leading = cut = first = last = None
        n, full, seen = 0, False, False  # n: pieces of the page so far; seen: whether the document had one that is no break
        names = ("doc_id", "block", "idx", "kind", "h", "need", "gap", "header", "moved")
        for batch in batches:
            out = []
            for d, block, idx, kind, h, need, gap, header, moved in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                new = page is None or d != doc
                if not new:
                    at = used + gap if used > 0 and used + gap <= height else used
                    fits = not full and (at == 0 or at + (h if kind == "text" and block == cut else need) <= height)
                if new or not fits:
                    if n:
                        out.append((doc, page - leading, *first, *last, n))
                    doc, page, leading, n = (d, 1, 0, 0) if new else (d, page + 1, leading, 0)
                    # a page that goes on with a table starts with its header again
                    at = header if kind == "table" and idx > 0 else 0
                    # the rest of a text that a page cuts, or that did not fit behind others, is placed line by line
                    cut = block if idx > 0 or moved else None
                    seen = seen and not new
                used, full = at + h, kind == "break"
                if full:
                    leading += not seen  # a break alone is an empty page, but for those that the document starts with
                else:
                    seen, last = True, (block, idx)
                    first = first if n else last
                    n += 1
            yield _pages(out)
        if n:
            yield _pages([(doc, page - leading, *first, *last, n)])

    return parts.sortWithinPartitions("doc_id", "block", "idx").mapInArrow(run, "doc_id long, page long, first_block long, first_part long, last_block long, last_part long, n_parts long")


def _pages(out: list) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * len(PAGES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PAGES)


def pages(blocks: DataFrame, height: int) -> DataFrame:
    """Rows (doc_id, page, first_block, first_part, last_block, last_part, n_parts): the pages of every document.

    blocks: doc_id, ord, kind (text, heading, figure, caption, table, break or another, which is not split), gap (to the block before),
    sizes (heights of a text's lines, of a table's body rows, or of the whole as one), header (height of a table's header, else 0). Heights are whole
    numbers of 1 or more. Distances between blocks are at most GAP, count if they fit, and never at a page's top. A piece that is higher than
    a page has a page of its own; a header doesn't wait for its first row. Between two forced breaks lies an empty page, which has no row here;
    breaks that start a document make none."""
    return placed(pieces(blocks.repartition("doc_id")), height)
