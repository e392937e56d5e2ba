"""Code that stands in a text without fences, and grids of tables whose cells span rows and columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formatting import code_blocks
from .lines import lines

#: Most rows or columns that a cell spans.
MAX_SPAN = 200
GRID = pa.schema([("table", pa.int64()), ("row", pa.int32()), ("place", pa.int32()), ("col", pa.int32()), ("width", pa.int32()), ("kind", pa.string())])


def code_snippets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, first_line, last_line, language) of code outside fences: balanced JSON, runs that begin like code, shell commands (one
    with a prompt, or two and more), as formatting.code_blocks() finds them. Fences are those of the text as it is. A null text has no rows."""
    rows = lines(docs).select("doc_id", "line_no", F.lit(0).alias("sub"), "line", F.lit(None).cast("string").alias("rule"))
    found = code_blocks(rows).where("block IS NOT NULL")
    return found.select("doc_id", F.col("line_no").alias("first_line"), F.col("block.end").alias("last_line"), F.col("block.lang").alias("language"))


def table_grid(cells: DataFrame) -> DataFrame:
    """Rows (table, row, place, col, width, kind) of tables: each cell with the grid column it starts at, and a ``continue`` for each
    column that a cell of an earlier row reaches down into. cells: table, row, cell, colspan, rowspan; spans are held to 1 to 200, and a wide
    cell takes over the columns it covers. Cells with equal numbers are taken by their spans; cells without a row are left out. Tables are
    dealt by number and folded in order, many to a batch of rows; what reaches down is all that is kept of a table."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, col, place = None, 0, 0  # here: table and row
        left: dict[int, int] = {}  # rows that are still to be filled below, by column

        def below(out: list) -> None:
            # what reaches into the row behind its last cell
            for c in sorted(k for k, n in left.items() if k >= col and n > 0):
                left[c] -= 1
                out.append((*here, place + len(out) - start, c, 1, "continue"))

        for batch in batches:
            out: list = []
            start = 0  # of the row's entries in out
            for table, row, colspan, rowspan in zip(*(batch.column(c).to_pylist() for c in ("table", "row", "colspan", "rowspan")), strict=True):
                if here != (table, row):
                    if here:
                        below(out)
                        if here[0] != table:
                            left = {}
                    here, col, place, start = (table, row), 0, 0, len(out)
                while left.get(col, 0) > 0:
                    out.append((table, row, place + len(out) - start, col, 1, "continue"))
                    left[col] -= 1
                    col += 1
                out.append((table, row, place + len(out) - start, col, colspan, "cell"))
                left.update(dict.fromkeys(range(col, col + colspan), rowspan - 1))
                col += colspan
            place += len(out) - start
            yield _batch(out)
        if here:
            out, start = [], 0
            below(out)
            yield _batch(out)

    span = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)), F.lit(MAX_SPAN)).cast("int").alias(c)
    rows = cells.where("row IS NOT NULL").select(F.col("table").cast("long"), F.col("row").cast("int"), "cell", span("colspan"), span("rowspan"))
    dealt = rows.repartition("table").sortWithinPartitions("table", "row", F.col("cell").asc_nulls_last(), "colspan", "rowspan")
    return dealt.mapInArrow(fold, "table long, row int, place int, col int, width int, kind string")


def _batch(out: list) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * len(GRID)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, GRID.types, strict=True)], schema=GRID)
