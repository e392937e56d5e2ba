"""Queries of extractor table functions and of archives, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.extractors import register
from ..functions.text import trim
from ..sources.archives import read_archives, write_archives
from ..sources.tables import read, scratch
from . import sqltext as Q


def _extracted(spark, sf, kind):
    register(spark)
    read(spark, sf, "pages").createOrReplaceTempView("inkwell_pages")
    return spark.sql(f"SELECT p.page_id, x.* FROM inkwell_pages p, LATERAL extract(p.html, '{kind}') x")


def page_links(spark, sf):
    return _extracted(spark, sf, "links")


def page_metadata(spark, sf):
    return _extracted(spark, sf, "metadata")


def page_tags(spark, sf):
    return _extracted(spark, sf, "tags")


def dialogue_runs(spark, sf):
    register(spark)
    read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").createOrReplaceTempView("inkwell_turns")
    return spark.sql("SELECT * FROM dialogue(TABLE(inkwell_turns))")


#: Characters that a document of a batch may have.
MOST = 15_000


def archive_outcomes(spark, sf):
    """Every document as a file of an archive, but for blank and long ones; what was written is read back."""
    d = read(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 19 == 0, " ").when(F.col("doc_id") % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    d = d.select("doc_id", text.alias("text"))
    error = F.when(trim(F.col("text")) == "", "empty").when(F.length("text") > MOST, "too long")
    name = F.concat(F.lit("texts/"), F.col("doc_id").cast("string"), F.lit(".md"))
    path = scratch(spark, "archives")
    outcomes = write_archives(d.select(name.alias("name"), "text", error.alias("error")), path)
    entries = read_archives(spark, path).select("archive", "name", F.sha2("data", 256).alias("sha256"))
    return outcomes.join(entries, ["archive", "name"], "left").select("name", "status", "reason", "n_bytes", "sha256")


QUERIES = {f.__name__: f for f in (page_links, page_metadata, page_tags, dialogue_runs, archive_outcomes)}

_LINK = """'<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>([^<]*)</a>'"""
_META = """'<meta\\b[^>]*?\\b(name|property|charset)="([^"]*)"(?:\\s+content="([^"]*)")?'"""
ORACLES = {
    "page_links": f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, {_LINK})) AS m, unnest(range(len(regexp_extract_all(html, {_LINK})))) AS n FROM pages)
      SELECT page_id, n, regexp_extract(m, {_LINK}, 1) AS href, regexp_extract(m, {_LINK}, 2) AS label FROM l""",
    "page_metadata": f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, {_META})) AS m FROM pages)
      SELECT page_id, regexp_extract(m, {_META}, 1) AS attribute, regexp_extract(m, {_META}, 2) AS key, CASE WHEN regexp_matches(m, '\\scontent="[^"]*"$') THEN regexp_extract(m, {_META}, 3) END AS content FROM l""",
    "page_tags": "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2",
    "dialogue_runs": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM conversations),
      b AS (SELECT *, sum((p IS DISTINCT FROM role)::INT) OVER (PARTITION BY conv_id ORDER BY k) AS run FROM a)
      SELECT conv_id, arg_min(turn, k) AS first_turn, role, count(*) AS n_messages, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM b GROUP BY conv_id, run, role""",
    "archive_outcomes": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN ' ' WHEN doc_id % 23 = 0 THEN NULL ELSE text END AS text FROM documents),
      r AS (SELECT *, CASE WHEN {Q.trim("text")} = '' THEN 'empty' WHEN length(text) > {MOST} THEN 'too long' WHEN text IS NULL THEN 'no text' END AS reason FROM t)
      SELECT 'texts/' || doc_id || '.md' AS name, CASE WHEN reason IS NULL THEN 'ok' ELSE 'skipped' END AS status, reason, CASE WHEN reason IS NULL THEN strlen(text) ELSE 0 END AS n_bytes, CASE WHEN reason IS NULL THEN sha256(text) END AS sha256 FROM r""",
}
