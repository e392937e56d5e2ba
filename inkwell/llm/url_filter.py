"""Operator 9 (native): URL rules by host-suffix and path-prefix expressions.

Each URL is expanded into all its (host suffix, path prefix) expressions; rules and expressions meet in an equi-join on the first
four bytes of a SHA-256, are confirmed by the full digest, and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rules are broadcast up to this number of rows, a bound checked by a count; beyond it the join shuffles and AQE splits hot prefixes.
BROADCAST_RULES = 200_000
#: Distinct lengths of rule paths for which prefixes are listed one by one; with more, all prefixes of a path are expanded.
PATH_LENGTHS = 64


def parts(url: str) -> tuple:
    """Host and path of a URL column. Host: behind the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: up to ``? #``.
    Null or no ``://``: both empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule (the winning rule's host + path, or null), verdict.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all subdomains if the path starts with the
    rule's path; the longest rule (host and path together) wins, at equal length the later text, and block over allow
    where one rule is listed with both verdicts. Repeated rules count once; rules with a null in any column are left out. URLs without
    a rule get ``default``. Null URLs have an empty host and path. Null ids and repeated rows each keep their row; URLs of any length are
    judged whole; other columns, whatever their names, are not read. An empty table of URLs gives no rows, one of rules the default.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    size = rules.agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.length("path"))), 1, PATH_LENGTHS + 1).alias("lengths")).first()
    # a rule listed with both verdicts blocks
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.concat("host", "path").alias("rule"), "verdict", F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"))
    rules = rules.select(F.substring("digest", 1, 8).alias("short"), F.col("digest").alias("rule_digest"), "rule", "verdict")
    host, path = parts(url_col)
    # the row number within its partition and the partition: a key for rows whose id is null or repeated
    rows = urls.select(F.col(id_col), F.col(url_col)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")))
    if len(size["lengths"]) > PATH_LENGTHS:
        prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    else:
        lengths = F.filter(F.array(*map(F.lit, size["lengths"])).cast("array<int>"), lambda n: n <= F.length("path"))
        prefixes = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    wide = rows.select("*", F.explode_outer(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("*", F.explode_outer("prefixes").alias("prefix"))
    wide = wide.select("row", id_col, "host", "path", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256).alias("digest"))
    wide = wide.withColumn("short", F.substring("digest", 1, 8))
    met = wide.join(F.broadcast(rules) if size["n"] <= BROADCAST_RULES else rules, "short", "left")
    fits = F.col("digest") == F.col("rule_digest")
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))))
    judged = met.groupBy("row").agg(F.first(id_col).alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The contract's rules: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP9_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT q.page_id, max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) AS best
      FROM q JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY q.page_id)
SELECT q.page_id, q.host, q.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict
FROM q LEFT JOIN m USING (page_id)
"""
