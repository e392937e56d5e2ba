"""Exported formulas and their lines, spans set aside and tables lifted out, against plain versions and golden cases."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import matching, spans

random.seed(3)


def plain(wanted, pool):
    left, out = [(line, "".join(f.split())) for f, line in pool], []
    for f in wanted:
        k = "".join(f.split())
        hit = next((c for c in left if c[1] == k), None) or next((c for c in left if k in c[1] or c[1] in k), None)
        if hit:
            left.remove(hit)
        out.append((f, hit[0] if hit else None))
    return out


def word():
    return "".join(random.choice("ab ") for _ in range(random.randint(0, 5))) + random.choice("ab")


def test_choices_with_consumption(spark):
    wanted = {d: [word() for _ in range(random.randint(0, 9))] for d in range(80)}
    pool = {d: [(word(), i) for i in range(random.randint(0, 9))] for d in range(80)}
    wanted[80], pool[80] = ["x"] * 40 + ["xy"] * 5, [("x", i) for i in range(30)] + [("x y z", 30 + i) for i in range(30)]
    wanted[81], pool[81] = [" ", "", "q"], [("q", 0), ("q", 1)]
    a = spark.createDataFrame([(d, i, f) for d, x in wanted.items() for i, f in enumerate(x)], "doc_id long, ord int, formula string")
    b = spark.createDataFrame([(d, i, f, line) for d, x in pool.items() for i, (f, line) in enumerate(x)], "doc_id long, ord int, formula string, line long")
    got = {}
    for r in matching.matched(a, b).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.formula, r.line))
    assert got.pop(81) == [(" ", None), ("", None), ("q", 0)]
    assert got == {d: plain(w, pool[d]) for d, w in wanted.items() if w and d != 81}
    quality = {r.doc_id: r for r in matching.export_quality(matching.matched(a, b), b).collect()}
    assert quality[80].n_degraded == 45 and quality[80].n_located == 45 and quality[81].lines == "?,?,0"


def test_no_candidates(spark):
    a = spark.createDataFrame([(1, 1, "x")], "doc_id long, ord int, formula string")
    b = spark.createDataFrame([], "doc_id long, ord int, formula string, line long")
    assert matching.matched(a, b).collect() == [(1, 1, "x", None)]


ASIDE = [
    ("boat", "boat", []),
    ("$a$ or $$b$$", "%%MATH_INLINE_1%% or %%MATH_BLOCK_0%%", ["b", "a"]),
    ("cost $5 and $ 6 $", "cost $5 and $ 6 $", []),
    (r"\[ u $v$ \] \(w\)", "%%MATH_BLOCK_0%% %%MATH_INLINE_1%%", ["u $v$", "w"]),
    (r"\[p $$q$$\]", "%%MATH_BLOCK_1%%", ["q", "p %%MATH_BLOCK_0%%"]),
    ("$$$ $x$$ $y$", "%%MATH_BLOCK_0%% %%MATH_INLINE_1%%", ["$ $x", "y"]),
    ("$　x$ $z$", "$　x$ %%MATH_INLINE_0%%", ["z"]),
    (None, None, []),
]


@pytest.mark.parametrize(("text", "held", "formulas"), ASIDE)
def test_set_aside(spark, text, held, formulas):
    row = spans.set_aside(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.text, [s.formula for s in row.spans]) == (held, formulas)


def test_stored_formulas_are_repaired(spark):
    held = spans.set_aside(spark.createDataFrame([(7, r"$ρ=25\rho=25ρ=25$ then $k$")], "doc_id long, text string"))
    got = spans.stored_formulas(held).orderBy("n").collect()
    assert [(r.doc_id, r.n, r.is_block, r.repaired) for r in got] == [(7, 0, False, r"\rho=25"), (7, 1, False, "k")]


HOISTED = [
    ("<p>plain</p>", "<p>plain</p>"),
    ("<p> &lt;table&gt;x&lt;/table&gt; </p>", "<table>x</table>"),
    ("<p>a &lt;table&gt;&lt;tr&gt;&lt;td&gt;1&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt; b</p><p>c</p>", "<p>a</p><table><tr><td>1</td></tr></table><p>b</p><p>c</p>"),
    ("<p>a &lt;table&gt;no cells&lt;/table&gt;</p>", "<p>a &lt;table&gt;no cells&lt;/table&gt;</p>"),
    ("<p>a &lt;table&gt;open</p>", "<p>a &lt;table&gt;open</p>"),
    ("<p>x &amp;lt;table y</p>", "<p>x &amp;lt;table y</p>"),
    ("", ""),
]


@pytest.mark.parametrize(("html", "want"), HOISTED)
def test_hoisted_tables(spark, html, want):
    assert spark.range(1).select(spans.hoist_tables(F.lit(html)).alias("h")).first().h == want


def test_matching_reads_stored_formulas_instead_of_the_texts(spark):
    from inkwell.plans import formulas

    files = [f.rsplit("/testdata/", 1)[-1] for f in formulas.export_quality(spark, "/root/testdata/sf0.001").inputFiles()]
    assert files and not [f for f in files if "documents" in f]


def test_neither_texts_nor_pieces_are_exchanged(spark):
    from inkwell.operators import formulas

    exchanges = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Exchange") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    docs = spark.createDataFrame([(1, "a $x$\n$$\ny\n$$ $z$\n$$u$$")], "doc_id long, text string")
    found = formulas.formulas(docs)
    assert sorted(map(tuple, found.collect())) == [(1, 1, False, "x"), (1, 2, True, "\ny\n"), (1, 4, False, "z"), (1, 5, True, "u")]
    assert exchanges(formulas.formulas(docs)) == 1
    values = spark.createDataFrame([(1, k) for k in ("a", "ab", "abc", "xabcx", "bc", "q", "cab")] + [(2, "abcd"), (2, "bcd")], "doc_id long, key string")
    dealt = values.repartition(2, "doc_id").distinct()
    assert exchanges(matching.containments(dealt)) == exchanges(dealt)
    every = {(d, x, y) for d, x in values.collect() for e, y in values.collect() if d == e and x != y and x in y}
    assert set(map(tuple, matching.containments(dealt).collect())) == every
