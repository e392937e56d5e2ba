"""Spans of a text that other rules must not touch: formulas set aside under place holders, tables lifted out of escaped paragraphs.

A text is cut at the spans of one form at a time, in the order of precedence; what is left between them, with the place holders in, is
looked through for the next form. So a span holds the place holders of the spans within it, and none is taken twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, let, trim
from .mangled import repaired

# Forms of formulas in the order they are set aside, and whether they are blocks.
FORMS = [
    (r"(?s)[$][$](.*?)[$][$]", True),
    (r"(?s)\\{1,2}\[(.+?)\\{1,2}\]", True),
    (rf"(?<![$])[$](?![{WS}])([^$\n]+?)(?<![{WS}])[$](?![$])", False),
    (r"\\{1,2}\(([^\n\r\x{2028}\x{2029}]+?)\\{1,2}\)", False),
]


def cut(text: Column, pattern: str, between: Column) -> Column:
    """The text with the n-th match of the pattern as the n-th of ``between``."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), between, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def set_aside(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, spans): the text with place holders, and an array of (n, is_block, formula) for them. Null stays null."""
    rows = docs.select("doc_id", "text", F.array().cast("array<struct<n:int,is_block:boolean,formula:string>>").alias("spans"))
    for pattern, block in FORMS:
        name, size = ("BLOCK" if block else "INLINE"), F.size("spans")
        rows = rows.withColumn("found", F.coalesce(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.array().cast("array<string>")))
        holders = F.transform("found", lambda x, i: F.concat(F.lit(f"%%MATH_{name}_"), (size + i).cast("string"), F.lit("%%")))
        new = F.transform("found", lambda x, i: F.struct((size + i).alias("n"), F.lit(block).alias("is_block"), trim(x).alias("formula")))
        rows = rows.select("doc_id", F.when(F.size("found") > 0, cut(F.col("text"), pattern, holders)).otherwise(F.col("text")).alias("text"), F.concat("spans", new).alias("spans"))
    return rows


def stored_formulas(held: DataFrame) -> DataFrame:
    """Rows (doc_id, n, is_block, formula, repaired) of what set_aside() holds."""
    rows = held.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.n").cast("long").alias("n"), "s.is_block", "s.formula")
    return repaired(rows)


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
PARAGRAPH = "(?s)<p>(.*?)</p>"
ESCAPED_TABLE = f"(?i)&lt;table[{WS}&gt;]"
TABLE = f"(?is)^(.*?)(<table[{WS}>].*</table>)(.*)\\z"
CELLS = f"(?is)<tr[{WS}>].*?<t[dh][{WS}>]"


def hoist_tables(html: Column) -> Column:
    """Paragraphs that hold an escaped table: a table alone takes the paragraph's place; with text around it, if it has a row with
    a cell, it stands between paragraphs of what comes before and behind. Others stay."""

    def paragraph(x: Column) -> Column:
        part = lambda i: trim(F.regexp_extract(x, TABLE, i))
        around = lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("<p>"), p, F.lit("</p>")))
        whole = trim(x).rlike(f"(?is)^<table[{WS}>].*</table>\\z")
        return F.when(whole, trim(x)).when(F.regexp_extract(x, TABLE, 2).rlike(CELLS), F.concat(around(part(1)), F.regexp_extract(x, TABLE, 2), around(part(3))))

    def decoded(inner: Column) -> Column:
        for entity, character in ENTITIES:
            inner = F.replace(inner, F.lit(entity), F.lit(character))
        return inner

    kept = lambda inner: F.concat(F.lit("<p>"), inner, F.lit("</p>"))
    lifted = lambda inner: F.coalesce(F.when(inner.rlike(ESCAPED_TABLE), let(decoded(inner), paragraph)), kept(inner))
    found = F.transform(F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1)), lifted)
    return F.when(html.rlike(ESCAPED_TABLE), cut(html, PARAGRAPH, found)).otherwise(html)
