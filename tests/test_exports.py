"""Archives of documents with their outcomes, failed writes, and extractor table functions."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import extractors
from inkwell.sources import archives

DOCS = [(i, f"texts/{i}.md", f"text {i} Füße\n" * i if i % 5 else None, "gate" if i % 7 == 3 else None) for i in range(40)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, name string, text string, error string").repartition(3)


def test_archives_and_outcomes(spark, docs, tmp_path):
    outcomes = {r.name: r for r in archives.write_archives(docs, f"file://{tmp_path}/out").collect()}
    entries = {r.name: (r.archive, r.data.decode()) for r in archives.read_archives(spark, f"file://{tmp_path}/out").collect()}
    want = {name: text for _, name, text, error in DOCS if text is not None and error is None}
    assert {n: t for n, (_, t) in entries.items()} == want
    assert {n for n, r in outcomes.items() if r.status == "ok"} == set(want) and len(outcomes) == len(DOCS)
    assert {r.reason for r in outcomes.values()} == {None, "gate", "no text"}
    assert all(outcomes[n].archive == a and outcomes[n].n_bytes == len(t.encode()) for n, (a, t) in entries.items())
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["archives", "outcomes"]


def test_a_failed_write_leaves_nothing(spark, docs, tmp_path):
    path = f"file://{tmp_path}/out"
    archives.write_archives(docs.where("id < 10"), path)
    before = sorted(p.name for p in (tmp_path / "out/archives").iterdir())
    broken = docs.withColumn("text", F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        archives.write_archives(broken, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["archives", "outcomes"]
    assert sorted(p.name for p in (tmp_path / "out/archives").iterdir()) == before


def test_appending_and_replacing(spark, docs, tmp_path):
    path = f"file://{tmp_path}/out"
    archives.write_archives(docs.where("id < 20"), path)
    assert archives.write_archives(docs.where("id >= 20"), path, "append").count() == 40
    assert archives.write_archives(docs.where("id = 1"), path).count() == 1
    assert archives.read_archives(spark, path).count() == 1


def test_nothing_to_write_gives_no_archive(spark, docs, tmp_path):
    path = f"file://{tmp_path}/out"
    assert {r.status for r in archives.write_archives(docs.where("text IS NULL"), path).collect()} == {"skipped"}
    assert list((tmp_path / "out/archives").iterdir()) == []
    with pytest.raises(Exception, match="error"):
        docs.select("name", "text").write.format(archives.FORMAT).option("path", path).mode("overwrite").save()


PAGE = '<meta charset="utf-8"><meta name="author" content="A. B."><p><a class="x" href="/one">One</a> <a href="">two</a><p>'


def test_extractors_have_their_own_columns(spark):
    extractors.register(spark)
    spark.createDataFrame([(1, PAGE), (2, None), (3, "none")], "page_id long, html string").createOrReplaceTempView("few_pages")
    found = lambda kind: spark.sql(f"SELECT p.page_id, x.* FROM few_pages p, LATERAL extract(p.html, '{kind}') x")
    assert found("links").columns == ["page_id", "n", "href", "label"]
    assert sorted(map(tuple, found("links").collect())) == [(1, 0, "/one", "One"), (1, 1, "", "two")]
    assert sorted(map(tuple, found("metadata").collect()), key=str) == [(1, "charset", "utf-8", None), (1, "name", "author", "A. B.")]
    assert sorted(map(tuple, found("tags").collect())) == [(1, "a", 2), (1, "meta", 2), (1, "p", 2)]
    with pytest.raises(Exception, match="kind must be one of"):
        found("colours").collect()


def test_dialogue_asks_for_its_rows_in_order(spark):
    extractors.register(spark)
    turns = [(1, 3, "user", "c"), (1, 1, "user", "ab"), (1, 2, "bot", None), (2, 1, "bot", "x"), (1, 4, "user", "de"), (1, 5, "bot", "f")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3).createOrReplaceTempView("few_turns")
    got = sorted(map(tuple, spark.sql("SELECT * FROM dialogue(TABLE(few_turns))").collect()))
    assert got == [(1, 1, "user", 1, 2), (1, 2, "bot", 1, 0), (1, 3, "user", 2, 3), (1, 5, "bot", 1, 1), (2, 1, "bot", 1, 1)]
