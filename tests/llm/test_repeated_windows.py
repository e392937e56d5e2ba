"""Operator 5's repeated windows: texts without any aren't sorted, others by generated code."""

from collections import Counter

from inkwell.llm import quality_rules as Q


def plain(text):
    w = (text or "").split()
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    found = Counter(windows)
    return len({i + j for i, x in enumerate(windows) if found[x] > 1 for j in range(3)})


def test_repeated_words(spark):
    texts = [None, "", "a", "a b c", "a b c d", "a a a a", "a b c x a b c", "a b c a b c a b c", "p q r s t u v w", "a b a b a"]
    made = Q.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.n_repeat_words for r in made.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    assert "array_sort(transform(v" not in made._jdf.queryExecution().optimizedPlan().toString() and "sort_array(transform(v" in made._jdf.queryExecution().optimizedPlan().toString()
