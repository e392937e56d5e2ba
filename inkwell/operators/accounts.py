"""Account analytics as relational plans: counters, caps, quotas, retention, access rules, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def ts(text: str) -> Column:
    return F.expr(f"timestamp_ntz '{text}'")


def dashboard(profiles: DataFrame, usage: DataFrame, histories: DataFrame, as_of: str) -> DataFrame:
    """One row of counters: one conditional aggregate per table, joined as single rows. New accounts of a week count whatever their
    status; the total counts active ones only."""
    week = ts(as_of) - F.expr("INTERVAL '7' DAY")
    p = profiles.agg(F.count_if(F.col("status") == "active").alias("users_total"), F.count_if(F.col("created_at") >= week).alias("users_new_7d"), F.count_if(~F.col("verified")).alias("users_unverified"), F.count_if(F.col("status") == "disabled").alias("users_disabled"))
    u = usage.agg(F.count_if(F.col("kind") == "anon").alias("exports_anon"), F.count_if(F.col("kind") == "user").alias("exports_user"))
    h = histories.agg(F.count("*").alias("histories_total"))
    both = F.col("exports_anon") + F.col("exports_user")
    return p.crossJoin(u).crossJoin(h).withColumn("conversion", F.round(1000 * F.col("exports_user") / F.nullif(both, F.lit(0))) / 10)


def usage_daily(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per UTC day of the last ``days`` times 24 hours: anonymous, user, docx and pdf exports. Days without events have no row."""
    recent = usage.where(F.col("created_at") >= ts(as_of) - F.expr(f"INTERVAL '{days}' DAY"))
    return recent.groupBy(F.date_trunc("day", "created_at").cast("date").alias("day")).agg(
        F.count_if(F.col("kind") == "anon").alias("anon"), F.count_if(F.col("kind") == "user").alias("user"), F.count_if(F.col("format") == "docx").alias("docx"), F.count_if(F.col("format") == "pdf").alias("pdf")
    )


def newest_per_class(histories: DataFrame, cap: int = 10) -> DataFrame:
    """The newest ``cap`` rows of each (user_id, is_draft), ties by id. Planned as a window with a group limit before the shuffle."""
    w = Window.partitionBy("user_id", "is_draft").orderBy(F.desc("created_at"), F.desc("id"))
    return histories.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)


def export_bundle(profiles: DataFrame, histories: DataFrame) -> DataFrame:
    """Per account its saved documents, newest first, as one JSON array; accounts without any get ``[]``."""
    item = F.to_json(F.struct("id", "title"))
    grouped = histories.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("k"), F.col("id").alias("i"), item.alias("j")))).alias("l"))
    bundle = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x.j), ","), F.lit("]"))
    return profiles.select("id").join(grouped, F.col("id") == F.col("user_id"), "left").select("id", F.coalesce(bundle, F.lit("[]")).alias("histories"))


def visible_rows(histories: DataFrame, sessions: DataFrame, owner: int) -> DataFrame:
    """Row-level access: the owner's own rows, and only while a session of that owner exists."""
    return histories.where(F.col("user_id") == owner).join(sessions.select("user_id"), "user_id", "left_semi")


def lockouts(logins: DataFrame, limit: int = 5, minutes: int = 15) -> DataFrame:
    """Sign-ins that are rejected, with ``failures``: ``limit`` or more of the account within the last ``minutes`` before them.

    A rejected sign-in is a failure itself, whatever its password was. Each round counts with what the rounds before have found; failures only
    grow, and a sign-in depends on earlier ones alone, so the rounds end with the one result. Rows of one time don't count for each other."""
    own = ("user_id", "us", "failed")
    rows = logins.withColumn("us", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("failed", ~F.col("success"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-minutes * 60 * 1_000_000, -1)
    while True:
        rows = stored(rows.withColumn("failures", F.coalesce(F.sum(F.col("failed").cast("int")).over(w), F.lit(0))), "lockouts")
        rejected = F.col("failures") >= limit
        if rows.where(rejected & ~F.col("failed")).isEmpty():
            return rows.where(rejected).drop(*own[1:])
        rows = rows.withColumn("failed", F.col("failed") | rejected)


def ordinal_limit(rows: DataFrame, keys: list[str | Column], order: list[str], limit: int, name: str = "n") -> DataFrame:
    """Numbers the rows of each key in order and tells which are within the limit (independent daily and lifetime quotas)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn(f"{name}_allowed", F.col(name) <= limit)


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: counts add up, last_seen is the later one, first_seen the earlier; keys of either side are kept."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key), (F.coalesce("o.n", F.lit(0)) + F.coalesce("n.n", F.lit(0))).alias("n"), F.least("o.first_seen", "n.first_seen").alias("first_seen"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen")
    )


def sessions(logins: DataFrame, hours: int = 2) -> DataFrame:
    """Sessions of each account: a new one starts after ``hours`` without a row."""
    w = Window.partitionBy("user_id").orderBy("created_at", "id")
    gap = F.col("created_at") > F.lag("created_at").over(w) + F.expr(f"INTERVAL '{hours}' HOUR")
    numbered = logins.withColumn("start", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("start").over(w))
    return numbered.groupBy("user_id", "session").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count("*").alias("n"))


def changed_saves(histories: DataFrame) -> DataFrame:
    """Saves that differ in title from the account's save before; the first of each account counts."""
    w = Window.partitionBy("user_id").orderBy("created_at", "id")
    return histories.withColumn("before", F.lag("title").over(w)).where(~F.col("title").eqNullSafe(F.col("before"))).drop("before")
