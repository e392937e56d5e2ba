"""Nested lists against a plain stack, and a golden case."""

import random

from inkwell.operators import nesting

random.seed(4)
TEXT = """1. oars
   - ash
   - spruce
     1. long
        - [ ] varnish
     2. short
2. sails
\t* jib

  still sails
1) anchors
next
- rope
```
- not here
```
+ chain"""
WANT = [
    (1, 0, 0, "ordered", 1, "1.", None), (2, 1, 1, "bullet", 1, "•", 1), (3, 1, 1, "bullet", 2, "•", 1), (4, 2, 2, "ordered", 1, "1.", 3), (5, 3, 3, "task", 1, "", 4), (6, 2, 2, "ordered", 2, "2.", 3),
    (7, 0, 0, "ordered", 2, "2.", None), (8, 1, 1, "bullet", 1, "•", 7), (11, 0, 0, "ordered", 3, "3.", None), (13, 0, 0, "bullet", 1, "•", None), (17, 0, 0, "bullet", 1, "•", None),
]


def test_golden_case(spark):
    got = nesting.nested_lists(spark.createDataFrame([(1, TEXT, 5)], "doc_id long, text string, run int")).drop("doc_id").orderBy("line_no").collect()
    assert [tuple(r) for r in got] == WANT


def plain(rows):
    out, stack = [], []
    for line, indent, kind in rows:
        popped = None
        while stack and stack[-1][0] >= indent:
            popped = stack.pop()
        number = popped[2] + 1 if popped and popped[1] == (kind == "ordered") else 1
        out.append((line, len(stack), min(len(stack), 4), kind, number, stack[-1][3] if stack else None))
        stack.append((indent, kind == "ordered", number, line))
    return out


def test_against_a_stack(spark):
    docs = {d: [(i + 1, random.randint(0, 7), random.choice(["ordered", "bullet", "task"])) for i in range(random.randint(0, 60))] for d in range(40)}
    mark = {"ordered": "7. x", "bullet": "- x", "task": "* [x] x"}
    texts = [(d, "\n".join(" " * n + mark[k] for _, n, k in rows)) for d, rows in docs.items()]
    got = {d: [] for d in docs}
    for r in nesting.nested_lists(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "line_no").collect():
        got[r.doc_id].append((r.line_no, r.depth, r.level, r.kind, r.number, r.parent))
    assert got == {d: plain(rows) for d, rows in docs.items()}
