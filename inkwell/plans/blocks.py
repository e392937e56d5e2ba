"""Queries of blocks, layout checks, health and selections, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import CJK
from ..operators import blocks as B
from ..operators import structure as T
from ..operators.documents import HEADING_LINE, IMAGE
from ..sources import tables as S
from ..sources.messy import MESSY_SQL, NL, messy
from . import sqltext as Q
from .accounts import values
from .structure import HEAD

_DOCS = "reference_sections list_numbers heading_groups stranded_headings limits".split()


def block_runs(spark, sf):
    return B.blocks(messy(spark, sf))


def health_confidence(spark, sf):
    rows = S.read(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("messages"), (F.col("user_id") % 5 == 0).cast("int").alias("misses"), (F.col("user_id") % 3).alias("fallbacks"))
    return B.confidence(rows).groupBy("confidence").agg(F.count("*").alias("n"))


def health_regressions(spark, sf):
    rows = S.read(spark, sf, "events").select("event_id", (F.col("user_id") % 12).alias("host"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 9).alias("messages"))
    return B.regressions(rows).select("event_id", "host", "before")


def script_runs(spark, sf):
    return B.script_runs(messy(spark, sf).select(F.col("doc_id").alias("id"), F.col("text")))


def character_sets(spark, sf):
    """Distinct characters of the texts of each language."""
    rows = S.read(spark, sf, "documents").select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''")
    return rows.distinct().groupBy("lang").agg(F.count("*").alias("n"), F.max("c").alias("last"))


def bounding_boxes(spark, sf):
    p = S.read(spark, sf, "lineitem")
    return p.groupBy("l_returnflag", "l_linestatus").agg(F.min("l_quantity").alias("x0"), F.min("l_discount").alias("y0"), F.max(F.col("l_quantity") + F.col("l_linenumber")).alias("x1"), F.max(F.col("l_discount") + F.col("l_tax")).alias("y1"))


def image_sizes(spark, sf):
    p = S.read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 30 - 90).alias("w"), F.col("p_size").alias("h"))
    w, h = B.image_size(F.col("w"), F.col("h") * 17)
    return p.select("p_partkey", w.alias("width"), h.alias("height"))


def header_footer(spark, sf):
    """Header and footer text of each page of a document: title left out on the first page, numbers by style."""
    d = S.read(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 3000).cast("int")))).alias("page"), F.ceil(F.col("n_chars") / 3000).cast("int").alias("pages"), "lang")
    number = F.when(F.col("doc_id") % 3 == 0, F.col("page").cast("string")).when(F.col("doc_id") % 3 == 1, F.concat_ws(" / ", F.col("page").cast("string"), F.greatest(F.col("pages"), F.lit(1)).cast("string"))).otherwise("")
    return d.select("doc_id", "page", F.when(F.col("page") == 1, "").otherwise(F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("header"), F.concat_ws(" ", F.col("lang"), F.nullif(number, F.lit(""))).alias("footer"))


#: Presets of templates.
TEMPLATES = [("general", 12, 360, False), ("academic", 11, 480, True), ("compact", 10, 240, False)]


def template_seed(spark, sf):
    """Presets under what the user has set."""
    t = spark.createDataFrame(TEMPLATES, "name string, font_size int, line_spacing int, numbered boolean")
    users = S.profiles(spark, sf).select("id", F.get(F.array(*(F.lit(n) for n, *_ in TEMPLATES)), (F.col("id") % 3).cast("int")).alias("name"), F.when(F.col("id") % 5 == 0, 14).alias("own_size"))
    return users.join(F.broadcast(t), "name").select("id", F.coalesce("own_size", "font_size").alias("font_size"), "line_spacing", "numbered")


def admin_sessions(spark, sf):
    """Sessions that hold: not revoked, not expired, their admin active."""
    rows = S.login_logs(spark, sf).where("success").select("id", "user_id", (F.col("id") % 13 == 0).alias("revoked"), (F.col("created_at") + F.expr("INTERVAL '2' HOUR")).alias("expires_at"))
    active = S.profiles(spark, sf).where("status = 'active'").select(F.col("id").alias("user_id"))
    now = F.expr("timestamp_ntz '2024-01-15 12:00:00'")
    return rows.where(~F.col("revoked") & (F.col("expires_at") > now) & (F.col("expires_at") <= now + F.expr("INTERVAL '6' HOUR"))).join(active, "user_id", "left_semi").select("id", "user_id")


def selections(spark, sf):
    """Chosen messages of each conversation: what inverting a choice of users and every third turn leaves."""
    m = S.read(spark, sf, "conversations").select("conv_id", "turn", "role")
    chosen = m.where("role = 'user'").unionByName(m.where("turn % 3 = 0")).distinct()
    return m.exceptAll(chosen)


def insert_absent(spark, sf):
    """Settings rows after defaults are put in where there is none."""
    have = S.profiles(spark, sf).where("id % 4 <> 0").select("id", F.lit("own").alias("origin"))
    wanted = S.profiles(spark, sf).select("id", F.lit("default").alias("origin"))
    return have.unionByName(wanted.join(have, "id", "left_anti")).groupBy("origin").agg(F.count("*").alias("n"))


def partial_retry(spark, sf):
    """A retry's results replace those of the same pages, new ones are added."""
    p = S.read(spark, sf, "pages")
    old, new = p.where("page_id % 4 <> 0").select("page_id", F.lit("first").alias("run")), p.where("page_id % 6 = 0").select("page_id", F.lit("retry").alias("run"))
    return old.join(new, "page_id", "left_anti").unionByName(new)


def ordinal_join(spark, sf):
    left = S.read(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), "turn")
    right = S.read(spark, sf, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), "turn")
    from pyspark.sql import Window

    number = lambda df: df.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn")).alias("ord"), F.col("turn").alias("value"))
    return B.zip_equal(number(left), number(right))


def match_once(spark, sf):
    e = S.read(spark, sf, "events").select((F.col("user_id")).alias("doc_id"), F.col("event_id").alias("ord"), F.floor("value").alias("value"), (F.col("event_id") % 2).alias("side"))
    return B.match_once(e.where("side = 0").drop("side"), e.where("side = 1").drop("side"))


#: Error codes and whether a retry helps.
ERRORS = [("E_NETWORK", True), ("E_QUOTA", False), ("E_EMPTY", False), ("E_TIMEOUT", True)]


def error_catalogue(spark, sf):
    codes = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(ERRORS)], "n long, code string, retry boolean")
    e = S.read(spark, sf, "events").where("event_type = 'error'").select((F.col("event_id") % 5).alias("n"))
    return e.join(F.broadcast(codes), "n", "left").groupBy(F.coalesce("code", F.lit("E_UNKNOWN")).alias("code"), F.coalesce("retry", F.lit(False)).alias("retry")).agg(F.count("*").alias("n"))


QUERIES = {name: (lambda f: lambda spark, sf: f(messy(spark, sf)))(getattr(B, name)) for name in _DOCS} | {f.__name__: f for f in (
    block_runs, health_confidence, health_regressions, script_runs, character_sets, bounding_boxes, image_sizes, header_footer, template_seed, admin_sessions, selections, insert_absent, partial_retry, ordinal_join, match_once, error_catalogue,
)}

_ROWS = "PARTITION BY doc_id ORDER BY line_no"
_WS = "[" + Q.WS + "]"
_KIND = f"""CASE WHEN in_fence THEN 'code' WHEN {Q.trim("line")} = '' THEN 'blank' WHEN regexp_matches(line, '{HEADING_LINE}') THEN 'heading' WHEN regexp_matches(line, '{T.SEPARATOR_ROW}') AND contains(line, '|') THEN 'separator' WHEN regexp_matches(line, '{T.TABLE_ROW}') THEN 'table'
  WHEN regexp_matches(line, '{T.ORDERED}') THEN 'ordered' WHEN regexp_matches(line, '{T.UNORDERED}') OR regexp_matches(line, '{T.BULLET}') THEN 'bullet' WHEN starts_with({Q.trim_start("line")}, '>') THEN 'quote' WHEN regexp_matches(line, '^{_WS}*{IMAGE}{_WS}*$') THEN 'image'
  WHEN starts_with({Q.trim("line")}, '$$') THEN 'math' WHEN regexp_matches(line, '^{_WS}*(-{{3,}}|[*]{{3,}}|_{{3,}}){_WS}*$') THEN 'rule' ELSE 'paragraph' END"""
_PREFIX = f"CASE {' '.join(f'''WHEN regexp_matches({Q.trim_start('line')}, '{p}') THEN '{t}' ''' for p, _, t in T.PREFIXES)} END"

ORACLES = {
    "block_runs": f"""WITH {HEAD}, a AS (SELECT *, {_KIND} AS kind FROM f), b AS (SELECT *, CASE WHEN lag(kind) OVER ({_ROWS}) = kind AND kind NOT IN ('heading', 'rule', 'image') THEN 0 ELSE 1 END AS s FROM a),
      c AS (SELECT *, sum(s) OVER ({_ROWS} ROWS UNBOUNDED PRECEDING) AS block FROM b) SELECT doc_id, kind, min(line_no) AS first_line, count(*) AS n FROM c WHERE kind <> 'blank' GROUP BY doc_id, block, kind""",
    "reference_sections": f"""WITH {HEAD}, a AS (SELECT *, max((NOT in_fence AND regexp_matches(line, '{B.REFERENCES}'))::INT) OVER ({_ROWS} ROWS UNBOUNDED PRECEDING) AS r FROM f) SELECT doc_id, min(line_no) AS from_line, count(*) AS n FROM a WHERE r = 1 GROUP BY 1""",
    "list_numbers": f"""WITH {HEAD}, a AS (SELECT *, NOT in_fence AND (regexp_matches(line, '{B.LIST_LINE}') OR regexp_matches(line, '{T.BULLET}')) AS item FROM f), b AS (SELECT *, sum((NOT item)::INT) OVER ({_ROWS} ROWS UNBOUNDED PRECEDING) AS run FROM a),
      c AS (SELECT *, CASE WHEN length(line) - length({Q.trim_start("line")}) >= 2 THEN 1 ELSE 0 END AS level FROM b WHERE item), d AS (SELECT *, count(*) FILTER (WHERE level = 0) OVER (PARTITION BY doc_id, run ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS top FROM c),
      e AS (SELECT *, sum(level) OVER (PARTITION BY doc_id, run, top ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS sub FROM d) SELECT doc_id, line_no, level, CASE WHEN level = 0 THEN top ELSE sub END AS number FROM e""",
    "heading_groups": f"""WITH {HEAD}, a AS (SELECT *, {_PREFIX} AS type FROM f WHERE NOT in_fence AND {Q.trim("line")} <> ''), b AS (SELECT *, CASE WHEN type IS NOT DISTINCT FROM lag(type) OVER ({_ROWS}) THEN 0 ELSE 1 END AS s FROM a), c AS (SELECT *, sum(s) OVER ({_ROWS} ROWS UNBOUNDED PRECEDING) AS grp FROM b)
      SELECT doc_id, type, min(line_no) AS first_line, count(*) AS n, CASE WHEN bool_or(length({Q.trim_start("line")}) > 100 OR regexp_matches(line, '[。！？]')) THEN 'list' ELSE 'heading' END AS verdict FROM c WHERE type IS NOT NULL GROUP BY doc_id, grp, type""",
    "stranded_headings": f"""WITH {HEAD}, a AS (SELECT *, NOT in_fence AND regexp_matches(line, '{HEADING_LINE}') AS h FROM f WHERE {Q.trim("line")} <> ''), b AS (SELECT *, coalesce(lead(h) OVER ({_ROWS}), true) AS nx FROM a) SELECT doc_id, line_no FROM b WHERE h AND nx""",
    "limits": f"""WITH {MESSY_SQL}, a AS (SELECT doc_id, {Q.count("text", B.EXTERNAL_IMAGE)} AS external_images, {Q.count("text", B.MEDIA)} AS media, length(text) > {B.MAX_CHARS} AS oversize,
      coalesce(list_max(list_transform(list_filter(string_split(text, '{NL}'), lambda x: regexp_matches(x, '{T.TABLE_ROW}')), lambda x: length(x) - length(replace(x, '|', '')) - 1)), 0) AS widest FROM messy) SELECT *, widest >= {B.MAX_COLUMNS} AS wide_table FROM a""",
    "health_confidence": "SELECT CASE WHEN event_id % 7 = 0 OR user_id % 5 = 0 THEN 'low' WHEN user_id % 3 > 0 THEN 'medium' ELSE 'high' END AS confidence, count(*) AS n FROM events GROUP BY 1",
    "health_regressions": """WITH r AS (SELECT event_id, user_id % 12 AS host, ts, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 9 END AS m FROM events),
      b AS (SELECT *, last_value(CASE WHEN m > 0 THEN m END IGNORE NULLS) OVER (PARTITION BY host ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT event_id, host, before FROM b WHERE m = 0 AND before >= 5""",
    "script_runs": f"""WITH {MESSY_SQL}, a AS (SELECT doc_id AS id, regexp_extract_all(text, '[{CJK}]+|[^{CJK}]+') AS l FROM messy) SELECT id, unnest(range(0, len(l))) AS place, unnest(l) AS run FROM a""",
    "character_sets": "WITH a AS (SELECT DISTINCT lang, unnest(list_distinct(string_split(text, ''))) AS c FROM documents) SELECT lang, count(*) AS n, max(c) AS last FROM a WHERE c <> '' GROUP BY 1",
    "bounding_boxes": "SELECT l_returnflag, l_linestatus, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + l_linenumber) AS x1, max(l_discount + l_tax) AS y1 FROM lineitem GROUP BY 1, 2",
    "image_sizes": f"""WITH a AS (SELECT p_partkey, p_size * 30 - 90 AS w0, p_size * 17 AS h0 FROM part), b AS (SELECT p_partkey, CASE WHEN w0 > 0 THEN w0 ELSE {B.DEFAULT_SIZE[0]} END AS w, CASE WHEN w0 > 0 AND h0 > 0 THEN h0 ELSE {B.DEFAULT_SIZE[1]} END AS h FROM a)
      SELECT p_partkey, least(w, {B.IMAGE_WIDTH}) AS width, CASE WHEN w > {B.IMAGE_WIDTH} THEN floor(h * {B.IMAGE_WIDTH} / w::DOUBLE + 0.5)::BIGINT ELSE h END AS height FROM b""",
    "header_footer": """WITH a AS (SELECT doc_id, lang, greatest(1, ceil(n_chars / 3000.0)::INT) AS pages FROM documents), b AS (SELECT *, unnest(range(1, pages + 1)) AS page FROM a)
      SELECT doc_id, page, CASE WHEN page = 1 THEN '' ELSE 'Document ' || doc_id END AS header, concat_ws(' ', lang, CASE doc_id % 3 WHEN 0 THEN page::VARCHAR WHEN 1 THEN page || ' / ' || pages END) AS footer FROM b""",
    "template_seed": f"""WITH {S.PROFILES_SQL}, t AS (SELECT * FROM {values([(i, *x) for i, x in enumerate(TEMPLATES)], "i, name, font_size, line_spacing, numbered")}) SELECT p.id, CASE WHEN p.id % 5 = 0 THEN 14 ELSE font_size END AS font_size, line_spacing, numbered FROM profiles p JOIN t ON t.i = p.id % 3""",
    "admin_sessions": f"""WITH {S.LOGINS_SQL}, {S.PROFILES_SQL}, a AS (SELECT *, created_at + INTERVAL 2 HOUR AS x FROM login_logs WHERE success AND id % 13 <> 0) SELECT id, user_id FROM a WHERE x > TIMESTAMP '2024-01-15 12:00:00' AND x <= TIMESTAMP '2024-01-15 18:00:00' AND EXISTS (SELECT 1 FROM profiles p WHERE p.id = a.user_id AND status = 'active')""",
    "selections": "SELECT conv_id, turn, role FROM conversations WHERE NOT (role = 'user' OR turn % 3 = 0)",
    "insert_absent": f"WITH {S.PROFILES_SQL} SELECT CASE WHEN id % 4 <> 0 THEN 'own' ELSE 'default' END AS origin, count(*) AS n FROM profiles GROUP BY 1",
    "partial_retry": "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'retry' ELSE 'first' END AS run FROM pages WHERE page_id % 6 = 0 OR page_id % 4 <> 0",
    "ordinal_join": """WITH n AS (SELECT conv_id AS doc_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ord, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations)
      SELECT a.doc_id, a.ord, a.turn AS a, b.turn AS b FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.ord = b.ord AND a.n = b.n AND a.role = 'user' AND b.role = 'assistant'""",
    "match_once": """WITH e AS (SELECT user_id AS doc_id, event_id AS ord, floor(value)::BIGINT AS value, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, floor(value), event_id % 2 ORDER BY event_id) AS k FROM events)
      SELECT a.doc_id, a.value, a.ord AS l, b.ord AS r FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.value = b.value AND a.k = b.k AND a.side = 0 AND b.side = 1""",
    "error_catalogue": f"""WITH c AS (SELECT * FROM {values([(i, *x) for i, x in enumerate(ERRORS)], "n, code, retry")}) SELECT coalesce(c.code, 'E_UNKNOWN') AS code, coalesce(c.retry, false) AS retry, count(*) AS n FROM events e LEFT JOIN c ON c.n = e.event_id % 5 WHERE event_type = 'error' GROUP BY 1, 2""",
}
