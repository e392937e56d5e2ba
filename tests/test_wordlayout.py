"""Small inputs with known results for the writer's decisions, bordered tables and bracket formulas."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import formulas, structure, wordlayout


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


HELD = [
    ("**注：**见下", "**注：\u200b**见下"), ("读**《河》**时", "读**\u200b《河》\u200b**时"), ("**ok,** go", "**ok,** go"), ("**表：**A1", "**表：\u200b**A1"), ("a*b*c", "a*b*c"), ("甲 **乙** 丙", "甲 **乙** 丙"), ("", ""), ("**", "**"), ("（*斜*）", "（\u200b*斜*\u200b）"),
]


def test_emphasis_beside_punctuation_is_held(spark):
    got = docs(spark, *(a for a, _ in HELD)).select("doc_id", wordlayout.hold_emphasis(F.col("text")).alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in got] == [b for _, b in HELD]


def test_emphasis_is_not_looked_back_from_every_character(spark):
    held = spark.createDataFrame([("x",)], "text string").select(wordlayout.hold_emphasis(F.col("text")))
    plan = held._jdf.queryExecution().logical().toString()
    assert "(?<=" in plan and ", (?<=" not in plan


@pytest.mark.parametrize(
    ("families", "bold", "italic", "face"),
    [("Nowhere", False, False, "sans"), ("Nowhere, Cambria, Arial", True, False, "serif-bold"), ("Arial, Consolas", False, False, "mono"), ("'KaTeX_Math', serif", False, False, "katex:Math-Italic"), ("Georgia, KaTeX_Main", True, True, "katex:Main-BoldItalic"), ("KaTeX_Size2", True, False, "katex:Size2"), ("", True, True, "sans-bold")],
)
def test_faces(spark, families, bold, italic, face):
    assert spark.range(1).select(wordlayout.font_key(F.lit(families), F.lit(bold), F.lit(italic))).first()[0] == face


def test_clusters_are_held_against_the_first_of_their_line(spark):
    rows = [(1, 1, 0.0, 10.0, 2.0), (1, 2, 5.0, 12.5, 2.0), (1, 3, 9.0, 14.0, 2.0), (1, 4, 1.0, 13.0, 2.0), (2, 5, 0.0, 0.0, 0.0)]
    got = sorted(map(tuple, wordlayout.page_lines(spark.createDataFrame(rows, "page long, id long, x double, top double, height double")).collect()))
    assert got == [(1, 1, 10.0, 3), (1, 2, 14.0, 1), (2, 1, 0.0, 1)]


def test_contents_stand_behind_the_first_block(spark):
    blocks = spark.createDataFrame([(1, 7, "heading"), (1, 9, "table"), (2, 1, "paragraph")], "doc_id long, ord long, kind string")
    got = sorted(map(tuple, wordlayout.assembled(blocks).collect()))
    assert got == [(1, 1, "heading"), (1, 2, "contents title"), (1, 3, "contents"), (1, 4, "table"), (2, 1, "paragraph"), (2, 2, "contents title"), (2, 3, "contents")]


def test_bordered_tables(spark):
    text = "+---+---+\n| a | b |\n+===+===+\n| c |\n+---+---+\ntext\n| x | y |\n| z | w |\n```\n+---+---+\n| p |\n| q |\n```"
    got = sorted(map(tuple, structure.grid_tables(docs(spark, text)).collect()))
    assert got == [(0, 2, "| a | b |", "|---|---|"), (0, 4, "| c |  |", None)]


def test_bracket_formulas(spark):
    got = sorted(map(tuple, formulas.delimited(docs(spark, "a \\(f(x)\\) b \\\\(y\\\\)", "\\[\nz\n\\] \\(no\nend\\)", "none")).collect()))
    assert got == [(0, False, "f(x)"), (0, False, "y"), (1, True, "\nz\n")]
