"""Whole texts formatted: golden cases of every rule and of what one rule leaves to the next."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import formatting, naming, wordfix, wordlayout

PARTS = [f"Chapter text {i} about rivers and boats." for i in range(24)]
CASES = {
    "null": (None, None),
    "empty": ("", ""),
    "only page numbers": ("7\n8\n\n9", "7\n8\n\n9"),
    "only invisible": ("​\n12", "​\n12"),
    "page numbers go": ("Boats leave.\n第 9 页\nBoats land.\nPage 2/9", "Boats leave.\nBoats land."),
    "page numbers in a fence stay": ("```\n3\n```\n4", "```\n3\n```"),
    "headers go": ("\n\n".join(f"{p}\nRiver Notes" if i % 10 == 0 else p for i, p in enumerate(PARTS)), "\n\n".join(PARTS)),
    "many headers stay": ("\n\n".join(f"{p}\nRiver Notes" if i % 3 == 0 else p for i, p in enumerate(PARTS)), "\n\n".join(f"{p}\nRiver Notes" if i % 3 == 0 else p for i, p in enumerate(PARTS))),
    "lines join": ("the boats of\nthe old town", "the boats of the old town"),
    "hyphen of a long stem goes": ("navi-\ngation", "navigation"),
    "hyphen of a short stem stays": ("by x-\nray", "by x-ray"),
    "stem over three lines": ("sai-\nl-\ning home", "sailing home"),
    "kept hyphen cuts the stem": ("x-\nra-\nys", "x-ra-ys"),
    "stem that isn't all letters": ("a1b-\nc", "a1b-c"),
    "CJK joins directly": ("河上有很多\n小船", "河上有很多小船"),
    "sentence ends stop": ("done!\nnext", "done!\nnext"),
    "dashes are no starters": ("- oars\n- sails", "- oars - sails"),
    "numbers are": ("1. oars\n2. sails", "1. oars\n2. sails"),
    "json": ('[\n{"a": [1]},\nb\n]\nend', '```json\n[\n{"a": [1]},\nb\n]\n```\nend'),
    "json without an end": ('{\n"a": 1', '{\n"a": 1'),
    "python": ("import math\nx = math.pi\n\nAll right.", "```python\nimport math\nx = math.pi\n```\n\nAll right."),
    "one line is no block": ("import math\n\nfine", "import math\n\nfine"),
    "console": ("console.log(1);\nrun();\n\nok", "```js\nconsole.log(1);\nrun();\n```\n\nok"),
    "shell": ("$ ls -l\n\nmany", "```bash\n$ ls -l\n```\n\nmany"),
    "one tool line": ("git is a tool\n\nyes", "git is a tool\n\nyes"),
    "two tool lines": ("git add it\ngit push it\n\nyes", "```bash\ngit add it\ngit push it\n```\n\nyes"),
    "block in a block": ("def f(x):\nimport y\nz = {\n\nrest", "```python\ndef f(x):\nimport y\nz = {\n```\n\nrest"),
    "typography": ("河边有Boat三条,很好!", "河边有 Boat 三条，很好！"),
    "code spans stay": ("看`船,数`吧,好", "看`船,数`吧，好"),
    "title": ("Rivers\n====\n\nthey flow", "# Rivers\n\nthey flow"),
    "underline below a blank line": ("flow.\n\n===\n\nebb", "flow.\n\n---\n\nebb"),
    "underline below a list": ("1. oar\n===", "1. oar\n==="),
    "underlines in a row": ("1. oar\n===\n===", "1. oar\n# ===\n"),
    "rules of all characters": ("a.\n\n****\n\n______\n\n······\n\n- - -\n\nb", "a.\n\n---\n\n---\n\n---\n\n---\n\nb"),
    "rule between text": ("a.\n****\nb", "a.\n****\nb"),
    "grid": ("+---+---+\n| a | b |\n+---+---+\n| c |\n+---+---+", "| a | b |\n|---|---|\n| c |  |"),
    "pipe rows": ("| a | b |\n| c | d |\n\n| e |", "| a | b |\n|---|---|\n| c | d |\n\n| e |"),
    "columns": ("depth:  3.\nwidth:  9.", "| depth: | 3. |\n|---|---|\n| width: | 9. |"),
    "tasks": ("□ row\n☑ sail", "- [ ] row\n- [x] sail"),
    "bullets": ("• row\n  ◦ sail", "- row\n  - sail"),
    "section name": ("结  论：\n\nwell", "## 结论\n\nwell"),
    "appendix": ("Appendix C", "## Appendix C"),
    "capitals": ("LIST OF BOATS\n\nNATO", "### LIST OF BOATS\n\nNATO"),
    "numbered titles": ("第三章 渡口\n1.2 Ferries\n1.2.3 Fares", "## 第三章 渡口\n### 1.2 Ferries\n#### 1.2.3 Fares"),
    "short numbers are titles": ("1.码头\n\n2.渡船", "## 1.码头\n\n## 2.渡船"),
    "one long number makes items": ("1.码头\n\n2.渡船很多。", "**1.**码头\n\n**2.**渡船很多。"),
    "a task between keeps the group": ("1.码头\n□ 看\n2.渡船很多。", "**1.**码头\n- [ ] 看\n**2.**渡船很多。"),
    "text between parts the group": ("1.码头\n\n看。\n\n2.渡船很多。", "## 1.码头\n\n看。\n\n**2.**渡船很多。"),
    "brackets": ("(3) Fares", "**(3) Fares**"),
    "bold number": ("**2.** Fares", "## 2. Fares"),
    "call-out": ("Warning: high tide", "> **Warning**：high tide"),
    "reference": ("[4] Tides of the bay", "**[4]** Tides of the bay"),
    "definition stays": ("[4]: https://tides.example.org/a", "[4]: https://tides.example.org/a"),
    "link": ("see https://tides.example.org/a_(b)), now", "see [https://tides.example.org/a_(b)](https://tides.example.org/a_(b))), now"),
    "link before a wide blank": ("at https://a.example　or www.b.example here", "at [https://a.example](https://a.example) or [www.b.example](https://www.b.example) here"),
    "link in quotes": ('<a href="https://a.example">x</a>', '<a href="https://a.example">x</a>'),
    "gaps": ("a.\n\n\n\nb.\n```\n\n\n```", "a.\n\nb.\n```\n\n\n```"),
}
STEADY = ["# Rivers\n\nThey flow, and boats go.\n\n| a | b |\n|---|---|\n| c | d |\n\n```py\nx = 1\n\n\n```\n\n- [x] done\n", "## 摘要\n\n河上有船。\n\n> **注意**：小心", "1. oars\n2. sails\n\n---\n\nend."]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(i, t, "extra") for i, (t, _) in enumerate(CASES.values())], "doc_id long, text string, line string")
    return {r.doc_id: r.text for r in formatting.formatted(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_cases(results, name):
    assert results[list(CASES).index(name)] == CASES[name][1]


def test_formatting_again_changes_nothing(spark):
    once = {n: CASES[n][1] for n in ("lines join", "json", "shell", "typography", "title", "rules of all characters", "grid", "pipe rows", "section name", "numbered titles", "call-out", "gaps")}
    texts = [*STEADY, *once.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in formatting.formatted(df).orderBy("doc_id").collect()] == texts


def test_empty_table(spark):
    assert formatting.formatted(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_edits_name_the_rule(spark):
    df = spark.createDataFrame([(1, "boats of\nthe town\n\n$ ls -l\n\n| a |\n| b |\n\n摘要\n\nText,same.")], "doc_id long, text string")
    got = sorted((r.line_no, r.sub, r.rule, r.line) for r in formatting.edits(df).collect())
    assert [(n, rule, line) for n, _, rule, line in got] == [(1, "rejoin", "boats of the town"), (4, "code", "```bash"), (4, "code", "```"), (6, "table", "|---|"), (9, "heading", "## 摘要")]


def test_one_exchange(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").repartition(3)
    plan = formatting.formatted_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


NAMES = [
    (["log.md", "log.md", "log(2).md"], ["log", "log(2)", "log(2)(2)"]),
    (["log(2).md", "log.md", "log.md", "log.md"], ["log(2)", "log", "log(3)", "log(4)"]),
    (["log.md", "log(3).md", "log.md", "log.md", "log(3).md"], ["log", "log(3)", "log(2)", "log(4)", "log(3)(2)"]),
    (["a.md", "a.txt", "b.md"], ["a", "a(2)", "b"]),
    (["", " .md"], ["untitled", "untitled(2)"]),
]


@pytest.mark.parametrize(("given", "want"), NAMES)
def test_entry_names(spark, given, want):
    got = naming.zip_names(spark.createDataFrame(list(enumerate(given)), "id long, name string")).orderBy("id").collect()
    assert [r.entry for r in got] == [f"{w}.docx" for w in want]


def test_links_end_at_wide_blanks(spark):
    rows = spark.createDataFrame([(1, 1, "https://a.example/x　y https://b.example z")], "doc_id long, line_no int, line string")
    assert [r.bare for r in wordfix.naked_links(rows).orderBy("n").collect()] == ["https://a.example/x", "https://b.example"]


@pytest.mark.parametrize(("text", "want"), [("a\x01b", "a\x01b"), ("\x01**船：**\x02\x01b", "\x01**船：​**\x02\x01b"), ("\x02a\x02b", "\x02a\x02b")])
def test_control_characters_stay(spark, text, want):
    assert spark.range(1).select(wordlayout.hold_emphasis(F.lit(text)).alias("t")).first().t == want


def test_windows_share_their_sorts(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    nodes = [line.lstrip(" :+-*()0123456789").split(" ")[0] for line in formatting.formatted(docs)._jdf.queryExecution().sparkPlan().toString().split("\n")]
    assert nodes.count("Window") <= 30
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = formatting.formatted(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Sort [") <= 13


def test_prose_matches_no_pattern(spark):
    from inkwell.operators import structure as S

    heads = ["Import x", "import os", "from a import b", "Def f", "def f", "class A", "function f", "print (", "console.log (", "$ ls", "npm i", "pip3 install", "apt-get update", "Section 2", "subsection 1", "Chapter 3", "part 4", "IV. x", "xi. x", "Note: x", "Tip：x", "EXAMPLE: y"]
    heads += ["page 7", "Page  9 of 10", "- a", "1. a", "1) a", "| a |", "|---|", "-----", "=====", "+--+--+", "[1] a", "[a]: b", "[x] a", "> q", "# t", "```", "{", "<b", "结论", "Über", "Øl", "plain text", "a", "Partly", "the quick", "** b **"]
    rows = [(pad + head + tail,) for pad in ("", " ", "\t　") for head in heads for tail in (" word" * 30, "", "-" * 120, " " * 120 + "7")]
    line, trimmed = F.col("line"), formatting.trim_start(F.col("line"))
    patterns = [S.PAGE_NUMBER, S.PAGE_NUMBER_CJK, S.TABLE_ROW, S.SEPARATOR_ROW, S.ORDERED, S.UNORDERED, S.BULLET, S.BOX_DONE, S.BOX_OPEN, S.GRID_BORDER, S.GRID_CONTENT, formatting.DEFINITION, formatting.UNDERLINE, formatting.RULE_LINE, formatting.MARKERS["ticks"]]
    starts = [*formatting.STARTERS, formatting.SHELL, formatting.DOLLAR, formatting.PYTHON, formatting.CONSOLE, formatting.QUOTE, formatting.REFERENCE, formatting.BOLD_PREFIX, "^(#|```|> )", "^[#>]", *(p for p, _, _ in formatting.NUMBERED)]
    special = [line.rlike(p) for p in patterns] + [trimmed.rlike(p) for p in starts]
    got = spark.createDataFrame(rows, "line string").select("line", formatting.prose(line).alias("prose"), F.array(*special).alias("special")).collect()
    assert [r.line for r in got if r.prose and any(r.special)] == []
    assert sum(r.prose for r in got) >= 20
