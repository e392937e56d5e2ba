"""Formulas pasted two or three times: golden cases and a plain search over all cuts."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inkwell.operators import mangled as M

STRIP = re.compile(M.LAYOUT)


def mapped(s):
    return "".join(M.NAMES.get(c, c) for c in s)


def key(s):
    return STRIP.sub("", mapped(s))


def score(s):
    return 2 * bool(re.search(M.COMMAND, s)) + 2 * bool(re.search(M.SCRIPT, s))


def trim(s):
    return re.sub(rf"^[{M.WS}]+|[{M.WS}]+\Z", "", s)


def plain(s):
    """Every pair of cuts in order."""
    n = len(s)
    if not 6 <= n <= 1200 or len(key(s)) < 12:
        return s
    same = lambda a, b: len(mapped(a)) == len(mapped(b)) and key(a) == key(b)
    three = None
    for i in range(4, n - 7):
        for j in range(i + 4, n - 3):
            a, b, c = s[:i], s[i:j], s[j:]
            e = (same(b, c), same(a, c), same(a, b))
            if any(e):
                three = ((a, b, c), -1 if sum(e) > 1 else e.index(True))
                if three[1] >= 0:
                    break
        if three and three[1] >= 0:
            break
    if three:
        pieces, odd = three
        if odd >= 0:
            p, other = pieces[odd], pieces[1 if odd == 0 else 0]
            if (re.search(M.COMMAND, p) or re.search(M.SCRIPT, p)) and len(key(p)) >= len(key(other)):
                return trim(p)
        return trim(max(pieces, key=score))
    for i in range(4, n - 3):
        if same(s[:i], s[i:]):
            return trim(max((s[:i], s[i:]), key=score))
    return s


def repair(spark, formulas):
    df = spark.createDataFrame(list(enumerate(formulas)), "no long, formula string")
    return [r.repaired for r in M.repaired(df).orderBy("no").collect()]


GOLDEN = [
    (r"ρ=25\rho=25ρ=25", r"\rho=25"),
    (r"\lambda = 7.5\lambda = 7.5\lambda = 7.5", r"\lambda = 7.5"),
    (r"v(0,s)=v(2,s)=1v(0,s)=v(2,s)=1v(0,s)=v(2,s)=1", "v(0,s)=v(2,s)=1"),
    (r"2.718×10−32.718\times10^{-3}2.718×10−3", r"2.718\times10^{-3}"),
    (r"a_{1}+b_{1}\geq 40a_{1}+b_{1}\geq 40", r"a_{1}+b_{1}\geq 40"),
    ("F=ma", "F=ma"),
    (r"w_{\rm in}(2,0.5)\approx0.4,\qquad w_{\rm out}(2,5)\approx0.9", None),
    ("", ""),
    (None, None),
    ("short", "short"),
    ("x" * 1300, "x" * 1300),
]


def test_golden_cases(spark):
    got = repair(spark, [f for f, _ in GOLDEN])
    assert got == [f if r is None else r for f, r in GOLDEN]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("ab1=_^{}\\ κ≤−", min_size=3, max_size=9), st.sampled_from(["AA", "AAA", "ABA", "AAB", "BAA", "A A", "A", "AABB"])), min_size=60, max_size=60))
def test_against_all_cuts(spark, given_):
    formulas = ["".join({"A": a, "B": key(a) + "_x"}.get(c, c) for c in way) for a, way in given_]
    formulas += [mapped(a) + a + mapped(a) for a, _ in given_]
    assert repair(spark, formulas) == [plain(f) for f in formulas]


def test_long_formula_of_one_character(spark):
    assert repair(spark, ["ab" * 600, "y" * 1200]) == [plain("ab" * 600), plain("y" * 1200)]


def test_lengths_of_characters_are_looked_up(spark):
    from pyspark.sql import functions as F

    each = [*M.NAMES, *"aZ9+_^{}\\ \t", "\u00a0", "\u3000", "\U0001d465", "é", "一"]
    rows = spark.createDataFrame([(c,) for c in each], "c string").select("c", M.widths(F.col("c")).alias("w")).collect()
    assert {r.c: tuple(r.w) for r in rows} == {c: (len(mapped(c)), len(key(c))) for c in each}


def test_names_and_second_cuts_are_not_tried_one_by_one(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("κ≤−x",)], "formula string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert rows.select(M.named(F.col("formula")).alias("m")).first().m == "kappaleq-x"
    assert plan(rows.select(M.named(F.col("formula")))).count("replace(") == 0
    assert "array_position" not in plan(M.repaired(rows))
