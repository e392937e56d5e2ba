"""Small inputs for JSON, settings, encodings and hashes."""

from pyspark.sql import functions as F

from inkwell.operators import structured


def test_share_errors(spark):
    rows = [(1, '{"data": {"biz_code": 0, "biz_data": {"messages": [{"role": "USER", "fragments": [{"type": "T", "content": " a "}]}]}}}'), (2, "<html>"), (3, '{"data": {"biz_code": 5}}'), (4, '{"data": {"biz_code": 0}}'), (5, None)]
    got = {r["conv_id"]: (r["content"], r["error"]) for r in structured.share_messages(spark.createDataFrame(rows, "conv_id long, body string")).collect()}
    assert got == {1: ("a", None), 2: (None, "not_json"), 3: (None, "refused"), 4: (None, "empty"), 5: (None, "not_json")}


def test_settings_of_any_shape(spark):
    rows = [(1, "{}"), (2, "[]"), (3, None), (4, '{"font_size": 99, "paper": "letter", "toc_levels": "2"}')]
    got = {r["id"]: (r["font_size"], r["toc_levels"], r["paper"]) for r in structured.settings(spark.createDataFrame(rows, "id long, json string")).collect()}
    assert got == {1: (12, 3, "a4"), 2: (12, 3, "a4"), 3: (12, 3, "a4"), 4: (32, 2, "letter")}


def test_misread_text_is_recovered(spark):
    bad = "中文内容很好".encode().decode("latin-1")
    got = structured.encoding_candidates(spark.createDataFrame([(1, bad)], "doc_id long, text string"), F.lit(True)).orderBy("rank").first()
    assert (got["name"], got["replaced"], got["recommended"]) == ("utf8", 0, True)


def test_hash_vectors(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "x string")
    assert [r[0] for r in df.select(structured.fnv1a(F.col("x"))).collect()] == ["811c9dc5", "e40c292c", "bf9cf968"]


def test_readings_are_made_a_few_texts_at_a_time(spark):
    """A batch of many texts isn't decoded as a whole; null, plain and misread texts, and ids of any type, as before."""
    import pyarrow as pa

    from inkwell.operators import structured as S

    texts = ["plain", "æ\u0080\u0081", ""] * 100
    out = list(S.decoded([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["doc_id", "text"])]))
    assert len(out) > 1 and max(b.num_rows for b in out) <= 4 * S.PART
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(i, t, p, *r) for i, t in enumerate(texts) for p, r in enumerate(S.decodings(t))] and len(got) >= 100
    docs = spark.createDataFrame([("a", None), ("b", "plain"), ("c", "æ\u0080\u0081")], "doc_id string, text string")
    rows = S.encoding_candidates(docs, F.lit(True)).collect()
    assert {r["doc_id"] for r in rows} == {"c"} and [r["name"] for r in rows if r["rank"] == 1] == ["utf8"]
