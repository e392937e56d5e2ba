"""Code without fences and tables with spans: small inputs with known results, and the queries' rows against plain versions."""

from inkwell.operators import snippets
from inkwell.plans import wordlayout

SF = "/root/testdata/sf0.001"
TEXTS = [
    ("$ ls", [(1, 1, "bash")]), ("git add it", []), ("git add it\nnpm run it\nplain", [(1, 2, "bash")]), ("text\nimport math\nx = 1\n\ny", [(2, 3, "python")]), ("import math\n\nx", []), ("console.log(1)\nb()\n- c", [(1, 2, "js")]),
    ("a = {\n[\n}\nafter", [(1, 3, "json")]), ("[\n1,\n[2]\n]", [(1, 4, "json")]), ("a {\nnever closed", []), ("```\nimport os\nx = 1\n```", []), ("print(1)\n河水流过。", []), ("print(1)\n| a | b |", []), ("{\n" + "x\n" * 49 + "}", []), ("", []), (None, []), ("print(1)\n" + "x\n" * 30, [(1, 20, "python")]),
]


def test_code_snippets(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    got = sorted(map(tuple, snippets.code_snippets(df).collect()))
    assert got == [(i, *s) for i, (_, found) in enumerate(TEXTS) for s in found]


def test_code_snippets_query(spark):
    found = {}
    for r in wordlayout.code_snippets(spark, SF).collect():
        found.setdefault(r["doc_id"], []).append((r["first_line"], r["last_line"], r["language"]))
    heads = [(2, 2, "bash"), (2, 3, "python"), (2, 4, "json"), (2, 3, "bash"), None, None, (2, 3, "js")]
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect():
        want = heads[r["doc_id"] % 7]
        assert (want in found.get(r["doc_id"], [])) if want else r["doc_id"] not in found or found[r["doc_id"]][0][0] > 5


def test_spans(spark):
    cells = [(1, 0, 0, 2, 2), (1, 0, 1, 1, 1), (1, 1, 0, 1, 3), (1, 2, 0, None, None), (1, 2, 1, 500, 0)]
    got = sorted(map(tuple, snippets.table_grid(spark.createDataFrame(cells, "table long, row int, cell int, colspan int, rowspan int")).collect()))
    assert got == [
        (1, 0, 0, 0, 2, "cell"), (1, 0, 1, 2, 1, "cell"), (1, 1, 0, 0, 1, "continue"), (1, 1, 1, 1, 1, "continue"), (1, 1, 2, 2, 1, "cell"), (1, 2, 0, 0, 1, "cell"), (1, 2, 1, 1, 200, "cell"),
    ]


def test_spans_query_against_a_plain_grid(spark):
    """Each column of each row is worked out on its own from the cells above and beside it."""
    tables = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect():
        n, q = r["l_linenumber"], int(r["l_quantity"])
        tables.setdefault(r["l_orderkey"], {}).setdefault((n - 1) // 3, []).append((n, max(q % 3, 1), max((q + n) % 4, 1)))
    want = []
    for key, by_row in tables.items():
        below = []  # (column, rows left) that reach into the row
        for row in sorted(by_row):
            reach, placed, col, after = dict(below), [], 0, []
            for _, width, height in sorted(by_row[row]):
                while reach.get(col, 0):
                    placed.append((col, 1, "continue"))
                    after.append((col, reach.pop(col) - 1))
                    col += 1
                placed.append((col, width, "cell"))
                for c in range(col, col + width):
                    reach.pop(c, None)
                    after.append((c, height - 1))
                col += width
            for c in sorted(reach):
                if reach[c]:
                    placed.append((c, 1, "continue"))
                    after.append((c, reach[c] - 1))
            below = after
            want += [(key, row, i, *p) for i, p in enumerate(placed)]
    assert sorted(map(tuple, wordlayout.table_grid(spark, SF).collect())) == sorted(want)


def test_spans_of_many_tables(spark):
    """Tables share a task and its batches; a table of many rows goes on in the next one; cells without a row are left out."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        cells = [(t, r, c, 1, 2) for t in range(40) for r in range(0, 10, 2) for c in (0, 1)] + [(7, None, 0, 1, 1), (None, 1, None, 2, 1), (None, 1, 0, 1, 1)]
        got = snippets.table_grid(spark.createDataFrame(cells, "table long, row int, cell int, colspan int, rowspan int"))
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # one call of Python for each table
        rows = sorted((tuple(x) for x in got.collect()), key=str)
        assert [x for x in rows if x[0] is None] == [(None, 1, 0, 0, 1, "cell"), (None, 1, 1, 1, 2, "cell")]
        for t in range(40):
            assert [x[1:] for x in rows if x[0] == t] == [x[1:] for x in rows if x[0] == 0]
        plain = {r: sorted(x[2:] for x in rows if x[0] == 0 and x[1] == r) for r in range(0, 10, 2)}
        assert plain[0] == [(0, 0, 1, "cell"), (1, 1, 1, "cell")]
        assert plain[2] == [(0, 0, 1, "continue"), (1, 1, 1, "continue"), (2, 2, 1, "cell"), (3, 3, 1, "cell")]
        assert plain[4] == [(0, 0, 1, "cell"), (1, 1, 1, "cell"), (2, 2, 1, "continue"), (3, 3, 1, "continue")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
