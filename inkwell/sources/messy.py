"""A deterministic view of ``documents`` with the defects that the text operators look for, in Spark and in SQL.

The tables' prose has hardly any Markdown, formulas or page furniture; each document gets a head of defective lines chosen by its
number, made of fixed text and of its own first characters. W stands for those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

NL = "\n"
W = object()
WORDS = 40
T = "```"

HEADS: list[list] = [
    ["##", W, "\nplain `code ", W, "\nok **bold ", W, "\n#tag **a** `x` and `y\n"],
    ["# Title ", W, "\n### Jump\ncost $x^2 and ", W, "\npay $100 now\n####### seven\n## \n#### Deep\n"],
    [T, "py\n##inside\n| a | b |\n| c\nx = 1\n", T, "\nafter **fence\n~~~\n##hidden\n"],
    ["| n | v |\n|---|---|\n| a\n| b | c | d |\n\n| lone\n\n| x | y\n| z\n  | p | q | r |  \nend\n"],
    ["$$\nx = 1\n##not a heading $y\n$$\nthen $$a$$ and $$\n", W, " ** inside\n"],
    ["Acme Report\n", W, "\nAcme Report\nAcme Report\n- Acme Report\n"],
    ["Page 3 of 10\n", W, "\n第 3 页\nPage 4/10\n- 5 -\n 12 \n共 12 页\nPage one\n", T, "\n7\n", T, "\n"],
    ["Along the ware-\nhouse walls of\n", W, "\nAsk them by e-\npost today\n河边的老船停在浅水里\n一直没有人来\nDone.\nNext line\n\n# Head\nbody\n"],
    ["A​B C ＡＢＣ１２３ ok\n\\(F = ma^2\\) inline \\[a+b\\]\n\\[\nz = 1\n\\]\n中文abc与123数字 , 中文 ! 好\n　全角\n总水深▒ωt^3\nωt_(2) y\n"],
    ["□ todo one\n☑ done two\n• item\n  ◦ nested\n1.1.1 Deep\n第二章 河流\n结  论\nReferences:\nRESULTS OF THE SURVEY\nPDF\n注意：小心\n[1] Ref one\nI. Introduction\n二、方法\n3. Third\n(4) four\nAppendix B\nSection 2.3 Data\nWarning: hot\n## References\n"],
    ["name  value  unit\na\tb\tc\nx  y  z\n\n\n\nlone  pair\ntext\n\n\nTitle line\n=====\n\nother\n---\n\n———\n\n", T, "\n\n\n\n", T, "\n"],
    ["<!-- pagebreak -->\ntext <!-- pagebreak --> inline\n===== Page 3 =====\n--- page 4\n*图 1：结构*\n_Table 2: Sizes_\n*Figure: plot*\n\\*\\*esc\\*\\* &lt;table &gt; ![alt](http://x.example.org/a.png) [link](https://y.example.org)\næ\u0080\u0081ç\u0081\u0082æ\u0080\u0081æ\u0081\u0082æ\u0083\u0084æ\u0085\u0086 ����\n"],
]


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, text)."""
    w = F.translate(F.substring("text", 1, WORDS), NL, " ")
    heads = [F.concat(*(w if p is W else F.lit(p) for p in parts)) for parts in HEADS]
    head = reduce(lambda c, i: c.when(F.col("doc_id") % len(HEADS) == i, heads[i]), range(len(HEADS)), F)
    body = F.when(F.col("doc_id") % len(HEADS) == 5, F.replace("text", F.lit(". "), F.lit(".\n"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(head, body).alias("text"))


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CASES = " ".join(f"WHEN {i} THEN " + " || ".join("w" if p is W else quote(p) for p in parts) for i, parts in enumerate(HEADS))
MESSY_SQL = f"""messy AS (SELECT doc_id, (CASE doc_id % {len(HEADS)} {_CASES} END) || CASE WHEN doc_id % {len(HEADS)} = 5 THEN replace(t, '. ', '.{NL}') ELSE t END AS text
  FROM (SELECT doc_id, text AS t, substr(replace(text, '{NL}', ' '), 1, {WORDS}) AS w FROM documents))"""
LINES_SQL = MESSY_SQL + f""", lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, '{NL}') AS l FROM messy))"""
