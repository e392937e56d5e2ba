"""Imports of conversations: their links, order, totals and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_href(url: Column) -> Column:
    """A URL with its scheme and host in lower case and a path of / where it has none."""
    parts = r"^([A-Za-z]+://[^/?#]*)([^?#]*)(.*)\z"
    path = F.regexp_extract(url, parts, 2)
    return F.concat(F.lower(F.regexp_extract(url, parts, 1)), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, parts, 3))


def import_items(rows: DataFrame) -> DataFrame:
    """The first line of each link of an import: id, place, href. rows: id, place, url; lines without a URL are left out."""
    hrefs = rows.where(F.col("url").rlike("^[A-Za-z]+://")).select("id", "place", normal_href(F.col("url")).alias("href"))
    return hrefs.groupBy("id", "href").agg(F.min("place").alias("place")).select("id", "place", "href")


def import_totals(results: DataFrame) -> DataFrame:
    """Messages and the joined documents of each import: id, messages, markdown. results: id, place, messages, markdown."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "markdown"))), lambda x: x.markdown)
    return results.groupBy("id").agg(F.sum("messages").alias("messages"), F.array_join(texts, "\n\n---\n\n").alias("markdown"))


def replay(entries: DataFrame, title: int = 120) -> DataFrame:
    """Saved entries in the order they are imported, oldest first: user_id, step, id, title. entries: user_id, id, title, created_at."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "id"))
    return entries.select("user_id", step.alias("step"), "id", F.left("title", F.lit(title)).alias("title"))


def notices(rows: DataFrame) -> DataFrame:
    """Different notices of each id in the order they first came: id, notices. rows: id, place, notice."""
    first = rows.groupBy("id", "notice").agg(F.min("place").alias("place"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "notice"))), lambda x: x.notice).alias("notices"))


def platform_title(title: Column, platform: Column) -> Column:
    """The title, with the platform in front unless it names it."""
    title = F.coalesce(title, F.lit(""))
    return F.when(title == "", platform).when(F.contains(F.lower(title), F.lower(platform)), title).otherwise(F.concat(platform, F.lit("-"), title))


def fingerprint(agent: Column, language: Column, width: Column, height: Column, colours: Column, zone: Column, cores: Column, touches: Column) -> Column:
    """Traits of a browser in one string; a missing zone is empty, missing counts are 0."""
    text = lambda x: x.cast("string")
    count = lambda x: text(F.coalesce(x, F.lit(0)))
    return F.concat_ws("|", agent, language, F.concat_ws("x", text(width), text(height), text(colours)), F.coalesce(zone, F.lit("")), count(cores), count(touches))


def erased(accounts: DataFrame, histories: DataFrame, leaving: Column, dropped: Column) -> tuple[DataFrame, DataFrame]:
    """Accounts and their histories after deletions: an account that leaves stays as a row with the status deleted, a dropped history
    goes."""
    return accounts.withColumn("status", F.when(leaving, "deleted").otherwise(F.col("status"))), histories.where(~F.coalesce(dropped, F.lit(False)))
