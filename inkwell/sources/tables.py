"""Tables of an sf_dir, and the views this package derives from them with fixed expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that stands for "now" in all queries over the event tables.
AS_OF = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='inkwell-')}"
    return f"{root.rstrip('/')}/inkwell/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there, which ends their lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def usage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export events: id, user_id, device_id, ip, kind (anon or user), format, created_at."""
    e = read(spark, sf_dir, "events").where("event_type <> 'error'")
    anon = F.col("user_id") % 3 == 0
    return e.select(
        F.col("event_id").alias("id"), F.when(~anon, F.col("user_id")).alias("user_id"), F.when(anon, F.col("user_id") % 40).alias("device_id"), (F.col("event_id") % 25).alias("ip"),
        F.when(anon, "anon").otherwise("user").alias("kind"), F.when(F.col("event_type") == "purchase", "pdf").otherwise("docx").alias("format"), F.col("ts").alias("created_at"),
    )


USAGE_SQL = """usage_logs AS (
  SELECT event_id AS id, CASE WHEN user_id % 3 <> 0 THEN user_id END AS user_id, CASE WHEN user_id % 3 = 0 THEN user_id % 40 END AS device_id, event_id % 25 AS ip,
         CASE WHEN user_id % 3 = 0 THEN 'anon' ELSE 'user' END AS kind, CASE WHEN event_type = 'purchase' THEN 'pdf' ELSE 'docx' END AS format, ts AS created_at
  FROM events WHERE event_type <> 'error')"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts: id, email, status, verified, role, created_at."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"), F.when(F.col("c_acctbal") < 0, "disabled").otherwise("active").alias("status"), (key % 4 != 0).alias("verified"),
        F.when(key % 50 == 0, "super").when(key % 50 == 1, "ops").when(key % 50 == 2, "support").alias("role"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(c_custkey % 31), int(c_custkey % 24))").alias("created_at"),
    )


PROFILES_SQL = """profiles AS (
  SELECT c_custkey AS id, lower(c_name) || '@example.org' AS email, CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status, c_custkey % 4 <> 0 AS verified,
         CASE WHEN c_custkey % 50 = 0 THEN 'super' WHEN c_custkey % 50 = 1 THEN 'ops' WHEN c_custkey % 50 = 2 THEN 'support' END AS role,
         TIMESTAMP '2024-01-01 00:00:00' + to_days((c_custkey % 31)::INT) + to_hours((c_custkey % 24)::INT) AS created_at
  FROM customer)"""


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved documents: id, user_id, title, is_draft, total, created_at."""
    return histories_of(read(spark, sf_dir, "orders"))


def histories_of(orders: DataFrame) -> DataFrame:
    """The same of any orders, a stream of them too."""
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") == "O").alias("is_draft"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("created_at"))


HISTORIES_SQL = """histories AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS title, o_orderstatus = 'O' AS is_draft, o_totalprice AS total, o_orderdate AS created_at FROM orders)"""


def login_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ins: id, user_id, ip, success, created_at."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 25).alias("ip"), (F.col("event_type") != "error").alias("success"), F.col("ts").alias("created_at"))


LOGINS_SQL = "login_logs AS (SELECT event_id AS id, user_id, event_id % 25 AS ip, event_type <> 'error' AS success, ts AS created_at FROM events)"


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first words are put into a table drawn with borders, by their number with or without all of its parts: doc_id, text."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id") % 4
    cell = F.translate(F.substring("text", 1, 12), "\n|", "  ")
    border, bars = F.lit("+-----+====+\n"), F.concat(F.lit("| k | "), cell, F.lit(" |\n"))
    text = F.concat(
        F.lit("before\n"), F.when(k == 3, "```\n").otherwise(""), F.when(k == 2, "").otherwise(border), bars, F.when(k == 1, "").otherwise(F.concat(F.lit(" | only one |\n|"), cell, F.lit("|x|y|  \n"))),
        F.when(k == 2, "").otherwise(border), F.when(k == 3, "```\n").otherwise(""), F.col("text"),
    )
    return d.select("doc_id", text.alias("text"))


GRID_SQL = """gridded AS (
  SELECT doc_id, 'before' || chr(10) || CASE WHEN k = 3 THEN '```' || chr(10) ELSE '' END || CASE WHEN k = 2 THEN '' ELSE b END || '| k | ' || c || ' |' || chr(10)
         || CASE WHEN k = 1 THEN '' ELSE ' | only one |' || chr(10) || '|' || c || '|x|y|  ' || chr(10) END || CASE WHEN k = 2 THEN '' ELSE b END || CASE WHEN k = 3 THEN '```' || chr(10) ELSE '' END || text AS text
  FROM (SELECT doc_id, text, doc_id % 4 AS k, translate(substr(text, 1, 12), chr(10) || '|', '  ') AS c, '+-----+====+' || chr(10) AS b FROM documents))"""
