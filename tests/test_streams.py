"""Stateful streams over several micro-batches, where a state outlives the batch that made it."""

import datetime as dt

from inkwell.streaming import jobs as J
from inkwell.streaming import stateful as K

START = dt.datetime(2024, 1, 1)


def stream(spark, folder, batches, schema):
    """One file, and so one micro-batch, for each list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    return source.parquet(f"{folder}/in")


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_payload_is_taken_once_and_in_time(spark, tmp_path):
    schema = "key long, id long, at timestamp, payload long"
    batches = [[(1, 1, at(0), 10), (2, 2, at(0), 20), (3, 3, at(0), 30)], [(1, 4, at(30), None), (2, 5, at(31), None)], [(1, 6, at(32), None), (3, 7, at(33), 31), (3, 8, at(34), None)], [(2, 9, at(40), None)]]
    got = rows(J.run(K.staging(stream(spark, tmp_path, batches, schema)), "append"))
    assert got == [(1, 4, 10), (1, 6, None), (2, 5, None), (2, 9, None), (3, 8, 31)]


def test_expired_payloads_are_swept(spark, tmp_path):
    schema = "key long, id long, at timestamp, payload long"
    batches = [[(1, 1, at(0), 10)], [(2, 2, at(200), 20)], [(2, 3, at(201), None)], [(1, 4, at(202), None)]]
    assert rows(J.run(K.staging(stream(spark, tmp_path, batches, schema), late="1 minute"), "append")) == [(1, 4, None), (2, 3, 20)]


def test_a_flag_is_put_out_when_it_changes(spark, tmp_path):
    schema = "key long, id long, at timestamp, generating boolean"
    batches = [[(1, 2, at(1), True), (1, 1, at(0), False)], [(1, 3, at(2), True), (2, 4, at(2), False)], [(1, 5, at(3), None), (2, 6, at(3), True)]]
    assert rows(J.run(K.flags(stream(spark, tmp_path, batches, schema)), "append")) == [(1, 2, True), (1, 5, False), (2, 6, True)]


def test_only_visits_with_messages_become_the_snapshot(spark, tmp_path):
    schema = "key long, id long, at timestamp, messages long"
    batches = [[(1, 1, at(0), 0), (1, 2, at(1), 6)], [(1, 3, at(2), 0)], [(1, 4, at(3), 0), (1, 5, at(4), 4), (1, 6, at(5), 0)]]
    assert rows(J.run(K.regressions(stream(spark, tmp_path, batches, schema)), "append")) == [(1, 3, 6), (1, 4, 6)]


def test_newer_counts_replace_older_ones(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    batches = [[(1, at(0), 1, "view"), (2, at(1), 3, "view")], [(3, at(2), 1, "click"), (4, at(3), 1, "error")]]
    got = rows(J.run(J.usage_daily(stream(spark, tmp_path, batches, schema)), "update", ("day", "kind")))
    assert got == [(START.date(), "anon", 1), (START.date(), "user", 2)]


def test_a_merged_table_keeps_the_newest(spark, tmp_path):
    batches = [[(1, 1), (1, 2), (2, 3)], [(1, 4)], [(2, 5), (1, 0)]]

    def newest(df):
        return df.groupBy("k").agg({"v": "max"}).toDF("k", "v")

    assert rows(J.run_merged(stream(spark, tmp_path, batches, "k long, v long"), newest, ("k",))) == [(1, 4), (2, 5)]


def test_a_table_in_a_folder_of_files_is_a_stream(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    spark.range(5).toPandas().to_parquet(f"{tmp_path}/one.parquet")
    for name, n in (("many", 10), ("one", 5)):
        assert rows(J.run(J.source(spark, str(tmp_path), name), "append")) == [(i,) for i in range(n)]
