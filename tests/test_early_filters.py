"""Line rules that leave lines out before their windows: the same rows, and a plan that sorts few of them."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import formatting as G
from inkwell.operators import lines as L
from inkwell.operators import repair as R
from inkwell.operators import structure as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def below_windows(df):
    """The part of the plan that the first window gets its rows from."""
    return plan(df).rsplit("Window [", 1)[1]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_blanks_are_cut_off_without_a_pattern(spark):
    edges = [*X.BLANKS, *(chr(c) for c in (0x85, 0x1C, 0x180E, 0x200B, 0x200C, 0x2060, 0x1F600))]
    rows = spark.createDataFrame([(c + "x y" + c,) for c in edges] + [("",), (X.BLANKS,), (None,)], "x string")
    x, ws = F.col("x"), X.WS
    pairs = [(X.trim(x), f"^[{ws}]+|[{ws}]+\\z"), (X.trim_start(x), f"^[{ws}]+"), (X.trim_end(x), f"[{ws}]+\\z")]
    for made, pattern in pairs:
        assert rows.where(~made.eqNullSafe(F.regexp_replace(x, pattern, ""))).count() == 0
        assert "regexp" not in plan(rows.select(made))


def test_short_texts_have_no_running_headers(spark):
    body = "\n".join(f"line {chr(97 + i)}" for i in range(26))
    texts = ["Acme\n" * 3 + body + "\nend", "Acme\n" * 3 + body]
    found = S.repeated_headers(docs(spark, *texts))
    assert sorted((r.doc_id, r.line_no, r.t) for r in found.collect()) == [(0, 1, "Acme"), (0, 2, "Acme"), (0, 3, "Acme")]
    assert "split(text" in below_windows(found).split("RepartitionByExpression")[1].split("Relation")[0]


def test_keyword_headings_window_over_candidates(spark):
    wide = " ".join("References") + " " * 200 + ":"
    found = S.keyword_headings(docs(spark, f"a line of prose\n{wide}\n```\nReferences\n```\nacknowledgements :\nAppendix  AB12:\nacknowledgementsx:"))
    assert sorted((r.line_no, r.heading) for r in found.collect()) == [(2, "## References"), (6, "## acknowledgements"), (7, "## Appendix AB12")]
    assert "Filter" in below_windows(found).split("Generate")[0]


@pytest.mark.parametrize("text", ["河边 ，好", "好,河", "好 . ", "a河", "（ 河", "河 ", "好:`x`河", "ＡＢ", "好　", "x​y", "河 a", "河\t\t", "è  ", "河!\n```\n河a\n```\n河a", "| 河a", "河"])
def test_typography_skips_only_lines_that_stay(spark, text):
    rows = docs(spark, text)
    whole = L.with_fences(L.lines(rows), "ticks").where("NOT in_fence").where(~F.col("line").rlike(S.TABLE_ROW) & F.col("line").rlike(f"[{X.CJK}{X.INVISIBLE}{X.WIDE}　]"))
    whole = whole.select("doc_id", "line_no", S.polished(F.col("line")).alias("text"), "line").where("text <> line").drop("line")
    found = S.typography(rows)
    assert sorted(found.collect()) == sorted(whole.collect())
    assert "Filter" in below_windows(found).split("Generate")[0]


def test_table_rows_are_mended_without_the_other_lines(spark):
    texts = ["| a | b |\n|---|---|\n| c\nprose\n| d\n| e | f\n\n  | g `x | h |\n | i\n", "$`c`$\n| a $ | b_1\n| c\n$$\n~~~\n| d | e |\n| f\n~~~\n##x\n| lone", "text\n|\n||\n| x | y |\n"]
    rows = docs(spark, *texts)
    whole = R.repair_tables(R.repair_inline(rows)).where("last_pipe OR missing_cells")
    found = R.repaired_rows(rows)
    keys = ("doc_id", "line_no", "table_fixed", "last_pipe", "missing_cells")
    assert sorted(found.select(*keys).collect()) == sorted(whole.select(*keys).collect()) != []
    assert "Filter" in below_windows(found).split("Generate")[0]


def test_documents_are_dealt_into_parts_that_do_not_grow(spark, monkeypatch):
    rows = docs(spark, *(f"one{i}\ntwo\nthree." for i in range(60)))
    few = sorted(G.paragraphs(rows).collect())
    monkeypatch.setattr(L, "DOCS_A_TASK", 2)
    assert "doc_id" in plan(L.dealt(rows)) and L.dealt(rows).rdd.getNumPartitions() == 30
    assert sorted(G.paragraphs(rows).collect()) == few != []


def test_lines_of_a_text_are_not_searched_for_what_stands_at_their_end(spark):
    rows = spark.createDataFrame([(x,) for x in ("", "a", "ab-", "x ab-", "xabc-", "河。", "a。b", "𝒳!", "…", None)], "x string")
    x = F.col("x")
    for n, pattern in ((1, G.SENTENCE_END), (1, G.DIRECT_END), (2, r"[a-zA-Z]-\z"), (4, r"[a-zA-Z]{3}-\z")):
        assert rows.where(~X.ends(x, n, pattern).eqNullSafe(x.rlike(pattern))).count() == 0
    joined = plan(G.paragraphs(docs(spark, "a\nb")))
    assert "right(" in joined.lower() or "substring" in joined.lower()
