"""Debounced streams over several batches: quiet rows, timers that fire in later batches, late rows, states that go; resumed runs."""

import datetime as dt

from pyspark.sql import functions as F

from inkwell.streaming import jobs as J
from inkwell.streaming import observing as O

from .test_streams import rows, stream

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, id long, at timestamp, value string"


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def run(spark, tmp_path, batches, **options):
    with O.rocks(spark):
        return rows(J.run(O.quiet(stream(spark, tmp_path, batches, SCHEMA), **options), "append"))


def test_what_pauses_is_put_out_in_a_later_batch(spark, tmp_path):
    batches = [[("a", 1, at(0), "x"), ("a", 2, at(300), "y")], [("a", 3, at(500), "z")], [("b", 4, at(5_000), "p")], [("c", 5, at(9_000), "q")]]
    assert run(spark, tmp_path, batches, gap=400, once=True, late="0 seconds") == [("a", 3, "z"), ("b", 4, "p")]


def test_a_message_comes_once_and_a_draft_when_it_differs(spark, tmp_path):
    edits = [[("a", 1, at(0), "x"), ("a", 2, at(2_000), "x"), ("a", 3, at(4_000), "y"), ("a", 4, at(4_100), "x")], [("a", 5, at(8_000), "x"), ("a", 6, at(10_000), "w")], [("z", 7, at(60_000), None)]]
    assert run(spark, tmp_path / "1", edits, gap=1_500, once=False, late="0 seconds") == [("a", 1, "x"), ("a", 6, "w")]
    assert run(spark, tmp_path / "2", edits, gap=1_500, once=True, late="0 seconds") == [("a", 1, "x")]


def test_late_rows_do_not_replace_newer_ones(spark, tmp_path):
    batches = [[("a", 1, at(10_000), "new")], [("a", 2, at(9_900), "old")], [("b", 3, at(30_000), "p")], [("a", 4, at(1_000), "too late"), ("c", 5, at(60_000), "q")]]
    assert run(spark, tmp_path, batches, gap=400, once=False, late="5 seconds") == [("a", 1, "new"), ("b", 3, "p")]


def test_what_was_told_is_dropped_after_its_time(spark, tmp_path):
    batches = [[("a", 1, at(0), "x")], [("b", 2, at(5_000), "p")], [("a", 3, at(6_000), "x")], [("b", 4, at(60_000), "p")], [("a", 5, at(61_000), "x")], [("c", 6, at(200_000), "q")]]
    kept = run(spark, tmp_path / "1", batches, gap=400, once=True, late="0 seconds", keep=10_000_000)
    swept = run(spark, tmp_path / "2", batches, gap=400, once=True, late="0 seconds", keep=20_000)
    assert kept == [("a", 1, "x"), ("b", 2, "p")]
    assert swept == [("a", 1, "x"), ("a", 5, "x"), ("b", 2, "p"), ("b", 4, "p")]


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    def more(n, batch):
        spark.createDataFrame(batch, "k long, v long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        source = spark.readStream.schema("k long, v long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return J.run_merged(source, lambda df: df.groupBy("k").agg(F.max("v").alias("v")), ("k",), buckets=4, path=f"{tmp_path}/out")

    assert rows(more(0, [(i, i) for i in range(20)])) == sorted(((i, i) for i in range(20)), key=str)
    before = {p.name for p in (tmp_path / "out/table").iterdir()}
    assert rows(more(1, [(3, 30)])) == sorted(((i, 30 if i == 3 else i) for i in range(20)), key=str)
    written = {p.name for p in (tmp_path / "out/table").iterdir()} - before
    assert [len([b for b in (tmp_path / "out/table" / w).iterdir() if b.name.startswith("bucket")]) for w in written] == [1]
