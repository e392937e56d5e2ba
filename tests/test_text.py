"""Small inputs with known results for the document operators."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import accounts, documents, extraction, formatting, formulas, layout, naming, repair, structure


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


REPAIRS = [
    ("##标题", "## 标题"), ("a `code", "a `code`"), ("河上**有一座桥", "河上**有一座桥**"), ("船票 $30 起，夜里加 $12。", "船票 $30 起，夜里加 $12。"), ("其中 $v=at^2 是速度", "其中 $v=at^2 是速度$"), ("一个独立的$符号", "一个独立的$符号"),
    ("| 名称 | 值 |\n|---|---|\n| 甲", "| 名称 | 值 |\n|---|---|\n| 甲 | |"), ("| lone", "| lone"), ("前文\n\n$$\nx = 1", "前文\n\n$$\nx = 1\n$$"), ("```python\nx = 1", "```python\nx = 1\n```"), ("$$\n\\text{船票 $9 起} y^3\n$$", "$$\n\\text{船票 $9 起} y^3\n$$"), ("", ""),
]


def test_repair(spark):
    got = {r["doc_id"]: r["text"] for r in repair.repair(docs(spark, *(a for a, _ in REPAIRS))).collect()}
    assert [got[i] for i in range(len(REPAIRS))] == [b for _, b in REPAIRS]


def test_repair_twice_is_repair_once(spark):
    once = repair.repair(docs(spark, *(a for a, _ in REPAIRS))).select("doc_id", "text")
    twice = repair.repair(once).select("doc_id", F.col("text").alias("again"))
    assert once.join(twice, "doc_id").where("text <> again").count() == 0


def test_clean_and_trim(spark):
    df = spark.createDataFrame([("  A​ＢＣ１２ x　﻿",)], "x string")
    assert df.select(X.trim(X.clean(F.col("x")))).first()[0] == "ABC12 x"
    assert df.select(X.let(F.length("x"), lambda n: n + n)).first()[0] == 2 * 12


def test_validation(spark):
    got = sorted(tuple(r) for r in documents.validate(docs(spark, "```\nopen", "a $$ b", "# ok\n## \n`x", "fine")).collect())
    assert got == [(0, 1, "open_fence", "error"), (1, 1, "open_math", "error"), (2, 2, "empty_heading", "warn"), (2, 3, "inline_code", "warn")]


@pytest.mark.parametrize(("line", "noise"), [("第 3 页", True), ("共 12 页", True), ("Page 4/10", True), ("- 5 -", True), ("Page one", False), ("3 apples", False)])
def test_page_numbers(spark, line, noise):
    assert (structure.page_number_noise(docs(spark, line)).count() == 1) == noise


@pytest.mark.parametrize(("text", "want"), [("Along the ware-\nhouse walls", "Along the warehouse walls"), ("by e-\npost today", "by e-post today"), ("河边的老船停在浅水里\n一直没有人来", "河边的老船停在浅水里一直没有人来"), ("one two\nthree", "one two three")])
def test_rejoin(spark, text, want):
    assert [r["text"] for r in structure.paragraph_rejoin(docs(spark, text)).collect()] == [want]


def test_headings_and_bullets(spark):
    rows = docs(spark, "结  论\nReferences", "RESULTS OF THE SURVEY\nPDF", "□ 浇水\n☑ 扫地\n• broom", "text\n=====", "I. Introduction\n第一章 x\n1.2 y")
    assert sorted(r["heading"] for r in structure.keyword_headings(rows).collect()) == ["## References", "## 结论"]
    assert [r["heading"] for r in structure.caps_headings(rows).collect()] == ["### RESULTS OF THE SURVEY"]
    assert sorted(r["text"] for r in structure.bullets(rows).collect()) == ["- [ ] 浇水", "- [x] 扫地", "- broom"]
    assert [r["text"] for r in formatting.setext(rows).where("text <> ''").collect()] == ["# text"]
    assert sorted(r["type"] for r in structure.heading_prefixes(rows.where("doc_id = 4")).collect()) == ["chap", "dot2", "roman"]


def test_formulas(spark):
    got = sorted(tuple(r) for r in formulas.formulas(docs(spark, "先写 $a+b$ 再另起\n\n$$\\frac{1}{2}$$\n$c$", "价格为 $5 与 $10 之间")).collect())
    assert got == [(0, 1, False, "a+b"), (0, 3, True, "\\frac{1}{2}"), (0, 4, False, "c")]


def test_pages_cover_all_lines(spark):
    text = "\n".join(["# head"] + ["word " * 40] * 100)
    rows = formulas.paginate(docs(spark, text), height=10).orderBy("page").collect()
    assert rows[0]["first_line"] == 1 and rows[-1]["last_line"] == 101
    assert all(a["last_line"] + 1 == b["first_line"] for a, b in zip(rows, rows[1:], strict=False))


def test_names(spark):
    assert naming.first_headings(docs(spark, "```\n# no\n```\n## **Yes** [x](y) ##")).first()["heading"] == "Yes x"
    assert naming.history_titles(docs(spark, "\n# " + "t" * 50)).first()["title"] == "t" * 40 + "…"
    got = naming.zip_names(spark.createDataFrame([(1, "a.md"), (2, "a.TXT"), (3, ".md")], "id long, name string"))
    assert sorted(r["entry"] for r in got.collect()) == ["a(2).docx", "a.docx", "untitled.docx"]


def test_split_count(spark):
    rows = spark.createDataFrame([(10, 4), (5, 4), (10, 1), (3, 9), (0, 3), (2, 1)], "t int, f int")
    assert [r[0] for r in rows.select(layout.split_count(F.col("t"), F.col("f"))).collect()] == [4, 3, 0, 3, 0, 0]


def test_platforms_and_links(spark):
    urls = spark.createDataFrame([(1, "chat.deepseek.com/share/abc"), (2, "https://example.com"), (3, "https://sub.kimi.com/x")], "id long, url string")
    hosts = spark.createDataFrame(extraction.HOSTS, "platform string, host string")
    assert {r["id"]: r["platform"] for r in extraction.platforms(urls, hosts).collect()} == {1: "deepseek", 3: "kimi"}
    text = spark.createDataFrame([(1, "见 https://a.com/x，www.b.org/y\nc.net/z; junk")], "id long, text string")
    assert [r["url"] for r in extraction.links(text).orderBy("place").collect()] == ["https://a.com/x", "www.b.org/y", "c.net/z"]


def test_lockout_counts_only_what_came_before(spark):
    rows = spark.createDataFrame([(i, 1, i == 5, f"2024-01-01 00:0{i}:00") for i in range(7)], "id long, user_id long, success boolean, t string")
    rows = rows.withColumn("created_at", F.to_timestamp_ntz("t"))
    got = accounts.lockouts(rows, limit=5).collect()
    assert sorted(r["id"] for r in got) == [5, 6]


def test_rejected_sign_ins_are_failures(spark):
    # from the sixth on all are rejected, right or wrong, and keep the account locked until a quarter of an hour without one
    times = [0, 1, 2, 3, 4, 5, 9, 13, 17, 18, 19, 20, 24, 40]
    rows = spark.createDataFrame([(i, 1, i >= 5, f"2024-01-01 00:{m:02}:00") for i, m in enumerate(times)], "id long, user_id long, success boolean, t string")
    got = accounts.lockouts(rows.withColumn("created_at", F.to_timestamp_ntz("t"))).orderBy("id").collect()
    assert [(r["id"], r["failures"]) for r in got] == [(5, 5), (6, 6), (7, 7), (8, 6), (9, 6), (10, 6), (11, 6), (12, 6)]


TYPOGRAPHY = [("山,水,云", "山，水，云"), ("风来!", "风来！"), ("看 `山,水` 和山,水", "看 `山,水` 和山，水"), ("见[山,水](http://a/山,水)吗?", "见[山,水](http://a/山,水)吗？"), ("雨  ", None), ("雨 ", "雨"), ("雨,  ", "雨，"), ("用ab写", "用 ab 写")]


def test_typography(spark):
    got = {r["doc_id"]: r["text"] for r in structure.typography(docs(spark, *(a for a, _ in TYPOGRAPHY))).collect()}
    assert [got.get(i) for i in range(len(TYPOGRAPHY))] == [b for _, b in TYPOGRAPHY]


def test_heading_levels(spark):
    got = structure.heading_prefixes(docs(spark, "Section 4 Boats\nSubsection 4.1 Oars\nChapter 2")).orderBy("line_no").collect()
    assert [r["level"] for r in got] == [3, 2, 2]


def test_export_bundle_escapes(spark):
    saved = spark.createDataFrame([(1, 7, 'a "quoted" \\ title', "2024-01-01 00:00:00")], "id long, user_id long, title string, created_at string")
    got = accounts.export_bundle(spark.createDataFrame([(7,), (8,)], "id long"), saved).orderBy("id").collect()
    assert [r["histories"] for r in got] == ['[{"id":1,"title":"a \\"quoted\\" \\\\ title"}]', "[]"]
