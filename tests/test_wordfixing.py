"""Whole texts made ready for a word processor: what one rule leaves to the next, options, and misread texts."""

from pyspark.sql import functions as F

from inkwell.operators import wordfixing

TEXT = "水深 \\(h\\) 与 ω_(1)\n\\[\nv = 3\n\\]\n\\begin{cases}\nw \\\\ u\n\\end{cases}\ngraph LR\nsea --> land\n```\nＡ_(2)\n```\nＡＢ​c d\nu_(2) ≤ 4"
FIXED = "水深 $h$ 与$ω_{1}$\n$$\nv = 3\n$$\n$$\n\\begin{cases}\nw \\\\ u\n\\end{cases}\n$$\n```mermaid\ngraph LR\nsea --> land\n```\n```\nＡ_(2)\n```\nABc d\n$$u_{2} \\le 4$$"


def run(spark, text, **options):
    row = wordfixing.fixed(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, line_no int"), **options).first()
    return row.text, {r.label: (r.n, r.lines) for r in row.report}


def test_all_rules(spark):
    text, report = run(spark, TEXT)
    assert text.split("\n")[1:] == FIXED.split("\n")[1:] and text.startswith("水深")
    assert report == {"bare environment": (1, [5]), "block delimiters": (2, [2, 4]), "diagram": (1, [8]), "inline delimiters": (1, [1]), "invisible characters": (1, [13]), "linear formula": (2, [1, 14]), "no-break spaces": (1, [13]), "wide letters": (1, [13])}


def test_options(spark):
    assert run(spark, TEXT, math=False, chart=False, structure=False) == (TEXT, {})
    text, report = run(spark, TEXT, math=False, structure=False)
    assert text == TEXT.replace("graph LR\nsea --> land", "```mermaid\ngraph LR\nsea --> land\n```") and set(report) == {"diagram"}
    text, _ = run(spark, TEXT, math=False, chart=False)
    assert text == TEXT.replace("ＡＢ​c d", "ABc d")


def test_nothing_to_fix(spark):
    assert run(spark, "plain\n\ntext") == ("plain\n\ntext", {}) and run(spark, "") == ("", {}) and run(spark, None) == (None, {})
    assert run(spark, "\n".join(["a​"] * 9)) == ("\n".join(["a"] * 9), {"invisible characters": (9, [1, 2, 3])})


def test_misread_texts_are_decoded_first(spark):
    misread = "水位 \\(h\\) 很高，船都走了".encode().decode("latin-1")
    rows = spark.createDataFrame([(1, misread), (2, "fine \\(h\\)"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.reading) for r in wordfixing.deep_fixed(rows, F.col("text").rlike("[à-ÿ][\u0080-¿]")).collect()}
    assert got == {1: ("水位 $h$ 很高，船都走了", "utf8"), 2: ("fine $h$", None), 3: (None, None)}


def test_environments_are_marked_without_reading_the_rows_again(spark):
    text = "\\begin{align}\n\\begin{cases}\n\\end{cases}\n\\end{align}\n$$\n\\begin{array}\n\\end{array}\n$$\n\\begin{gathered}\\end{gathered}\n\\begin{split}"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = wordfixing.with_environments(wordfixing.lines(docs).select("doc_id", "line_no", F.lit(0).alias("sub"), "line", F.array().cast("array<string>").alias("fixes")))
    got = [r.line for r in rows.orderBy("line_no", "sub").collect()]
    assert got == ["$$", *text.split("\n")[:4], "$$", *text.split("\n")[4:8], "$$", text.split("\n")[8], "$$", text.split("\n")[9]]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
