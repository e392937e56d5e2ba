"""Structured Streaming forms of the stateful behaviours. Each takes a streaming DataFrame and returns one; run() drains what is
available and leaves the result in a table, so a batch query can be held against it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import scratch


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, one file or a folder of files, as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # as a pattern the path may name a file; a plain one must be a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run(stream: DataFrame, mode: str, keys: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Runs the stream over all that is there (trigger availableNow) and reads its result back from the shared folder.

    In update mode a batch writes only the rows that it changed; of rows with equal ``keys`` the latest batch's holds. With the ``path`` of
    an earlier run of the same stream it goes on where that ended."""
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")
    if mode != "complete":  # so that there is a result where the stream has no batch
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/result/batch=-1")

    def sink(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder; complete mode replaces the whole result
        target = f"{path}/result" if mode == "complete" else f"{path}/result/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    _drain(stream, mode, sink, path)
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{path}/result").select(*stream.columns)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/result")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("newest")).select(*keys, "newest.*")


def run_merged(stream: DataFrame, merge: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], buckets: int = 64, path: str | None = None) -> DataFrame:
    """Keeps a table up to date: after each batch it is merge(table and batch together). merge() treats every value of ``keys`` on its own.

    The table is kept in buckets of the keys. A batch reads and writes only the buckets that its rows fall into, under its own number; of a bucket
    the greatest number holds. So a batch that is run again starts from the same table, and a later run with the same ``path`` finds it."""
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/table/batch=-1/bucket=-1")
    schema = StructType([*stream.schema.fields, StructField("batch", LongType()), StructField("bucket", LongType())])

    def newest(rows: DataFrame) -> DataFrame:
        # one row a bucket
        held = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(held), ["bucket", "batch"])

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))

    def sink(batch: DataFrame, number: int) -> None:
        rows = bucketed(batch).persist()
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
        before = spark.read.schema(schema).parquet(f"{path}/table").where((F.col("batch") < number) & F.col("bucket").isin(touched))
        merged = merge(newest(before).select(*batch.columns).unionByName(rows.drop("bucket")))
        bucketed(merged.select(*batch.columns)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/table/batch={number}")
        rows.unpersist()

    _drain(stream, "append", sink, path)
    return newest(spark.read.schema(schema).parquet(f"{path}/table")).select(*stream.columns)


def _drain(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], path: str) -> None:
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def usage_daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Exports per day and kind."""
    rows = events.where("event_type <> 'error'").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 3 == 0, "anon").otherwise("user").alias("kind"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def sessions(logins: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions per account: one ends when nothing comes for ``gap``."""
    rows = logins.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    grouped = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))
    return grouped.select("user_id", "first_at", "last_at", "n")


def failures(events: DataFrame, minutes: int = 15, slide: int = 5, limit: int = 2) -> DataFrame:
    """Accounts with ``limit`` failures or more within a sliding window."""
    rows = events.where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    grouped = rows.withWatermark("ts", "1 hour").groupBy(F.window("ts", f"{minutes} minutes", f"{slide} minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.where(F.col("n") >= limit).select("user_id", F.col("w.start").alias("start"), "n")
