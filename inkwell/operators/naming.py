"""Names and titles derived from texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, trim
from .lines import lines, with_fences

# Characters and forms that the names drop.
ATX = rf"^[{WS}]{{0,3}}#{{1,6}}[{WS}]+([^\n]+?)[{WS}]*#*[{WS}]*\z"
ILLEGAL = r"[\\/:*?\x22<>|\x00-\x1f]"
ZIP_EXT = r"(?i)[.](md|markdown|txt)\z"


def bare(x: Column) -> Column:
    """Without image, link and emphasis syntax."""
    x = F.regexp_replace(F.regexp_replace(x, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return trim(F.regexp_replace(x, "[*_`~]", ""))


def first_headings(docs: DataFrame) -> DataFrame:
    rows = with_fences(lines(docs), "ticks").where(~F.col("in_fence") & F.col("line").rlike(ATX))
    return rows.groupBy("doc_id").agg(bare(F.regexp_extract(F.min_by("line", "line_no"), ATX, 1)).alias("heading"))


def safe_name(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, ILLEGAL, " "), f"[{WS}]+", " ")
    return trim(F.left(F.regexp_replace(x, rf"^[.{WS}]+|[.{WS}]+\z", ""), F.lit(60)))


def file_names(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """Title, else first heading, else a dated default. titles: doc_id, title."""
    rows = docs.select("doc_id").join(titles, "doc_id", "left").join(first_headings(docs), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.nullif(safe_name(F.col("title")), F.lit("")), F.nullif(safe_name(F.col("heading")), F.lit("")), F.lit("Document-2024-01-31")).alias("name"))


def history_titles(docs: DataFrame) -> DataFrame:
    """First line with text, without Markdown marks, 40 characters and an ellipsis."""
    text = F.filter(F.transform(F.split("text", "\n", -1), lambda x: trim(F.regexp_replace(F.regexp_replace(x, f"^#{{1,6}}[{WS}]+", ""), "[*`>]", ""))), lambda x: x != "")
    first = F.get(text, F.lit(0))
    return docs.select("doc_id", F.when(first.isNull(), "Untitled").when(F.length(first) > 40, F.concat(F.left(first, F.lit(40)), F.lit("…"))).otherwise(first).alias("title"))


def zip_names(files: DataFrame) -> DataFrame:
    """Entry names: extension dropped, illegal characters replaced, 80 characters; a name that an earlier file has gets the first free number
    from 2 on. files: id, name.

    A number can only meet a name that already ends in one, so files are apart by the name without its numbers in brackets. Where no file
    of such a family has one, its place in its name's order is the number; other families, which are few and as large as
    their names are alike, are folded in order."""
    safe = F.left(F.coalesce(F.nullif(trim(F.regexp_replace(F.regexp_replace("name", ZIP_EXT, ""), ILLEGAL, "_")), F.lit("")), F.lit("untitled")), F.lit(80))
    rows = files.select("id", safe.alias("stem")).withColumn("family", F.regexp_replace("stem", r"(\([0-9]+\))+\z", ""))
    rows = rows.withColumn("meets", F.max(F.col("stem") != F.col("family")).over(Window.partitionBy("family")))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("id"))
    plain = rows.where("NOT meets").withColumn("n", n)
    plain = plain.select("id", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")"))).otherwise(""), F.lit(".docx")).alias("entry"))
    out = rows.select("id").schema.add("entry", "string")

    def fold(family: pd.DataFrame) -> pd.DataFrame:
        used, free, entries = set(), {}, []
        family = family.sort_values("id", kind="stable")
        for stem in family["stem"]:
            name = stem
            if name in used:
                # numbers below the last one given are taken for good
                number = free.get(stem, 2)
                while (name := f"{stem}({number})") in used:
                    number += 1
                free[stem] = number + 1
            used.add(name)
            entries.append(f"{name}.docx")
        return family[["id"]].assign(entry=entries)

    return plain.unionByName(rows.where("meets").select("id", "stem", "family").groupBy("family").applyInPandas(fold, out))
