"""Two-tier matching with consumption: which line of a text an exported formula comes from.

Exported formulas choose in their order: the first candidate that is equal without blanks, else the first that contains the formula or is
contained in it; what is chosen is gone. Candidates are found by classes of equal texts: a text that lies in another
shares all its pieces of three characters with it, so it is looked up under the one that fewest texts of the document have, and then
compared. The choice itself is a fold over a document's classes, which keeps how many of each are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, let

#: Characters of a piece; shorter texts are their own piece.
PIECE = 3
#: Candidates that a task takes where pieces are made of them.
ROWS_A_TASK = 10_000


def key(x: Column) -> Column:
    return F.regexp_replace(x, f"[{WS}]", "")


def pieces(x: Column, size: Column | int) -> Column:
    """The distinct pieces of a text of one size."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: x.substr(i, n)))


def containments(values: DataFrame) -> DataFrame:
    """Rows (doc_id, inner, outer): texts of a document of which one lies in the other, different ones. values: doc_id, key; distinct, and
    dealt by doc_id, so that the pieces, of which there are many times as many as texts, are not exchanged."""
    over = lambda *by: Window.partitionBy("doc_id", *by)
    # pieces as short as the shortest texts only where there are such texts
    values = values.withColumn("sizes", F.collect_set(F.least(F.length("key"), F.lit(PIECE))).over(over()))
    posted = values.select("doc_id", F.col("key").alias("outer"), F.explode(F.array_distinct(F.flatten(F.transform("sizes", lambda n: pieces(F.col("key"), n))))).alias("piece"))
    posted = posted.withColumn("n", F.count("*").over(over("piece")))
    # a text's own pieces of its size, the rarest of them
    own = F.length("piece") == F.least(F.length("outer"), F.lit(PIECE))
    posted = posted.withColumn("rarest", F.min(F.when(own, F.struct("n", "piece"))).over(over("outer"))).where("n > 1")
    inners = F.collect_list(F.when(F.col("rarest.piece") == F.col("piece"), F.col("outer"))).over(over("piece"))
    met = posted.withColumn("inners", inners).withColumn("inners", F.filter("inners", lambda x: (F.length(x) < F.length("outer")) & F.col("outer").contains(x)))
    return met.select("doc_id", F.explode("inners").alias("inner"), "outer")


def matched(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, formula, line): every wanted formula with the line of the candidate it gets, null if there is none.

    wanted: doc_id, ord, formula; pool: doc_id, ord, formula, line. Texts that are blank match nothing. An order (ord) is unique within
    a document on each side. Equal candidates are one class with a queue, so many copies of a formula make no pairs."""
    a = wanted.select("doc_id", "ord", "formula", key(F.col("formula")).alias("key")).where("key <> ''")
    b = pool.select("doc_id", "ord", "line", key(F.col("formula")).alias("key")).where("key <> ''")
    queues = b.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("queue"))
    values = a.select("doc_id", "key").union(b.select("doc_id", "key"))
    wanted_parts = max(-(-pool.count() // ROWS_A_TASK), wanted.sparkSession.sparkContext.defaultParallelism)
    near = containments(values.repartition(wanted_parts, "doc_id").distinct())
    way = lambda key, other: F.struct(F.col(key).alias("key"), F.col(other).alias("other"))
    near = near.select("doc_id", F.inline(F.array(way("inner", "outer"), way("outer", "inner"))))
    own = a.select("doc_id", "key").distinct()
    choices = own.select("doc_id", "key", F.col("key").alias("other")).union(near.join(own, ["doc_id", "key"], "left_semi"))
    choices = choices.join(queues.select("doc_id", F.col("key").alias("other")), ["doc_id", "other"], "left_semi")
    choices = choices.groupBy("doc_id", "key").agg(F.collect_list("other").alias("others"))
    rows = a.join(choices, ["doc_id", "key"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "others", "formula"))).alias("rows"))
    classes = queues.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "queue"))).alias("queues"))
    both = rows.join(classes, "doc_id", "left").withColumn("names", F.coalesce(F.map_keys("queues"), F.array().cast("array<string>")))

    def step(acc: Column, row: Column) -> Column:
        gone = lambda k: F.get(acc.gone, (F.array_position("names", k) - 1).cast("int"))
        first = lambda k: F.get(F.element_at("queues", k), gone(k))
        left = F.filter(F.coalesce(row.others, F.array().cast("array<string>")), lambda k: first(k).isNotNull())
        # equal ones before others, then by their order
        best = F.array_min(F.transform(left, lambda k: F.struct((k != row.key).alias("other"), first(k).ord.alias("ord"), k.alias("key"), first(k).line.alias("line"))))

        def taken(best: Column) -> Column:
            more = F.transform(acc.gone, lambda n, i: n + F.when(F.get("names", i) == best.key, 1).otherwise(0))
            got = F.struct(row.ord.alias("ord"), row.formula.alias("formula"), best.line.alias("line"))
            return F.struct(F.when(best.isNull(), acc.gone).otherwise(more).alias("gone"), F.concat(acc.out, F.array(got)).alias("out"))

        return let(best, taken)

    types = dict(a.dtypes) | dict(b.dtypes)
    none = F.array().cast(f"array<struct<ord:{types['ord']},formula:string,line:{types['line']}>>")
    start = F.struct(F.transform("names", lambda k: F.lit(0)).alias("gone"), none.alias("out"))
    found = both.select("doc_id", F.explode(F.aggregate("rows", start, step, lambda acc: acc.out)).alias("x")).select("doc_id", "x.ord", "x.formula", "x.line")
    blank = wanted.where(key(F.col("formula")) == "").select("doc_id", "ord", "formula", F.lit(None).cast(types["line"]).alias("line"))
    return found.unionByName(blank)


def export_quality(report: DataFrame, pool: DataFrame) -> DataFrame:
    """One row per document with formulas: n_formulas, n_degraded, n_located, lines (of the degraded ones, in their order)."""
    by_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x.line)
    degraded = report.groupBy("doc_id").agg(F.count("*").alias("n_degraded"), F.count("line").alias("n_located"), by_order.alias("lines"))
    rows = pool.groupBy("doc_id").agg(F.count("*").alias("n_formulas")).join(degraded, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("doc_id", "n_formulas", zero("n_degraded"), zero("n_located"), F.array_join(F.coalesce("lines", F.array().cast("array<int>")), ",", "?").alias("lines"))
