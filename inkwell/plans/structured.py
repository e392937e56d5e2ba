"""Queries over JSON, settings, encodings and hashes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedded as E
from ..operators import structured as O
from ..operators.documents import LATIN_CJK
from ..sources.messy import NL, messy
from ..sources.tables import read
from . import sqltext as Q
from .documents import ORACLES as _DOCS


def share_messages(spark, sf):
    """Replies built from the conversations: some refused, some broken; each message with a thinking fragment."""
    c = read(spark, sf, "conversations")
    fragments = F.array(F.struct(F.lit("THINKING").alias("type"), F.lit("hm").alias("content")), F.struct(F.lit("RESPONSE").alias("type"), F.col("text").alias("content")))
    message = F.struct("turn", F.upper("role").alias("role"), fragments.alias("fragments"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m.role.alias("role"), m.fragments.alias("fragments"))).alias("messages"))
    code = F.when(F.col("conv_id") % 7 == 0, 3).otherwise(0)
    body = F.to_json(F.struct(F.struct(code.alias("biz_code"), F.struct(F.lit("t").alias("title"), "messages").alias("biz_data")).alias("data")))
    return O.share_messages(g.select("conv_id", F.when(F.col("conv_id") % 11 == 5, "<html>").otherwise(body).alias("body")))


def embedded_json(spark, sf):
    p = read(spark, sf, "pages")
    html = F.concat(F.lit('<script type="application/ld+json">{"@type": "Page", "id": '), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "").otherwise("}"), F.lit('</script><script id="x" type="application/json">[1, 2]</script>'), F.col("html"))
    return O.embedded_json(p.select("page_id", html.alias("html")))


def doc_settings(spark, sf):
    p = read(spark, sf, "part")
    json = F.when(F.col("p_partkey") % 9 == 0, "not json").otherwise(F.to_json(F.struct((F.col("p_size") * 20).alias("line_spacing"), F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).otherwise("x").alias("font_size"), F.when(F.col("p_size") % 2 == 0, "letter").otherwise("a3").alias("paper"))))
    return O.settings(p.select(F.col("p_partkey").alias("id"), json.alias("json")))


def stack_hash(spark, sf):
    return read(spark, sf, "part").select("p_partkey", O.fnv1a(F.concat("p_brand", F.lit(":"), F.col("p_partkey").cast("string"))).alias("hash"))


def navigation_junk(spark, sf):
    link = F.concat(F.lit("[a](https://x.example.org)\n- [b](/y)\n[c](http://z)\n[d](https://w)\n"), F.lit(""))
    return O.navigation_junk(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 3 == 0, link).otherwise(""), "text").alias("text")))


def stats_report(spark, sf):
    """A text report of each document's counts."""
    from ..operators.documents import stats

    return stats(messy(spark, sf)).select("doc_id", F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("headings", "table_rows", "images", "code_blocks", "chars"))).alias("report"))


def encoding_candidates(spark, sf):
    return O.encoding_candidates(messy(spark, sf), F.col("text").rlike(LATIN_CJK))


#: A fixed value: the test key of tickets.
KEY = b"not a secret"


def export_tickets(spark, sf):
    e = read(spark, sf, "customer")
    return e.select("c_custkey", O.tickets(F.concat(F.lit('{"u":'), F.col("c_custkey").cast("string"), F.lit("}")), KEY).alias("ticket"))


def json_messages(spark, sf):
    """Messages of three shapes in nested JSON, one in seven broken."""
    c = read(spark, sf, "conversations")
    one = F.to_json(F.struct(F.struct(F.col("role").alias("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content")))
    two, three = F.to_json(F.struct("role", "text")), F.to_json(F.struct("role", F.col("text").alias("content")))
    item = F.when(F.col("turn") % 3 == 0, one).when(F.col("turn") % 3 == 1, two).otherwise(three)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("j")))), lambda s: s.j), ",")
    rows = c.groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit('{"a": 1, "data": {"items": [['), items, F.lit("]]"), F.when(F.col("conv_id") % 7 == 3, "").otherwise("}}")).alias("json"))
    return E.json_messages(rows).select("id", "path", "role", "content")


QUERIES = {f.__name__: f for f in (share_messages, embedded_json, doc_settings, stack_hash, navigation_junk, stats_report, encoding_candidates, export_tickets, json_messages)}


_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
ORACLES = {
    "export_tickets": f"""WITH p AS (SELECT c_custkey, encode('{{"u":' || c_custkey || '}}') AS m FROM customer)
      SELECT c_custkey, to_base64(m) || '.' || to_base64(unhex(sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || m))))) AS ticket FROM p""",
    "json_messages": f"""WITH n AS (SELECT conv_id AS id, role, {Q.trim("text")} AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE conv_id % 7 <> 3)
      SELECT id, '.000001.000000.000000.' || lpad(k::VARCHAR, 6, '0') AS path, role, content FROM n WHERE role <> 'system' AND content <> ''""",
    "share_messages": f"""WITH m AS (SELECT conv_id, turn, role, 'hm' AS think, {Q.trim("text")} AS content FROM conversations WHERE role <> 'system' AND {Q.trim("text")} <> ''), c AS (SELECT DISTINCT conv_id FROM conversations),
      e AS (SELECT c.conv_id, CASE WHEN conv_id % 11 = 5 THEN 'not_json' WHEN conv_id % 7 = 0 THEN 'refused' WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.conv_id = c.conv_id) THEN 'empty' END AS error FROM c)
      SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY turn) - 1 AS ord, role, content, NULL::VARCHAR AS error FROM m JOIN e USING (conv_id) WHERE e.error IS NULL UNION ALL SELECT conv_id, 0, NULL, NULL, error FROM e WHERE error IS NOT NULL""",
    "embedded_json": "SELECT page_id, 0 AS n, 'Page' AS kind FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 1, NULL FROM pages",
    "doc_settings": """SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 OR p_size % 3 = 0 THEN 12 ELSE least(greatest(p_size, 8), 32) END AS font_size, CASE WHEN p_partkey % 9 = 0 THEN 360 ELSE least(greatest(p_size * 20, 240), 720) END AS line_spacing, 3 AS toc_levels,
      CASE WHEN p_partkey % 9 <> 0 AND p_size % 2 = 0 THEN 'letter' ELSE 'a4' END AS paper, 'portrait' AS orientation FROM part""",
    "stack_hash": "SELECT p_partkey, lower(lpad(printf('%X', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_brand || ':' || p_partkey, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0')) AS hash FROM part",
    "navigation_junk": f"""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '[a](https://x.example.org){NL}- [b](/y){NL}[c](http://z){NL}[d](https://w){NL}' ELSE '' END || text AS text FROM documents),
      l AS (SELECT id, list_filter(list_transform(string_split(text, '{NL}'), lambda x: {Q.trim("x")}), lambda x: x <> '') AS l FROM t WHERE length(text) < 1200)
      SELECT id FROM l WHERE len(l) >= 4 AND len(list_filter(l, lambda x: regexp_matches(x, '^\\[.*\\]\\(https?://') OR regexp_matches(x, '^[-#>*]*[ \\t]*\\[.*\\]\\('))) / len(l)::DOUBLE > 0.6""",
    "stats_report": f"WITH s AS ({_DOCS['doc_stats']}) SELECT doc_id, concat_ws('{NL}', 'headings: ' || headings, 'table_rows: ' || table_rows, 'images: ' || images, 'code_blocks: ' || code_blocks, 'chars: ' || chars) AS report FROM s",
}
