"""Streaming queries, drained with availableNow, and further document queries; their SQL runs over the same tables in one go."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import formulas as M
from ..operators import structure as T
from ..sources import tables as S
from ..sources.messy import MESSY_SQL, NL, messy
from ..streaming import jobs as J
from ..streaming import observing as O
from ..streaming import stateful as K
from . import sqltext as Q


#: Where the time of messages starts.
BASE_MS = 1_700_000_000_000


def stream_usage_daily(spark, sf):
    return J.run(J.usage_daily(J.source(spark, sf, "events")), "update", ("day", "kind"))


def stream_sessions(spark, sf):
    out = J.run(J.sessions(J.source(spark, sf, "events")), "complete")
    return out.select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n")


def stream_failures(spark, sf):
    return J.run(J.failures(J.source(spark, sf, "events")), "update", ("user_id", "start")).select("user_id", F.unix_micros("start").alias("start_us"), "n")


def stream_new_messages(spark, sf):
    """Messages as a page shows them: a turn stands a third of a second after the one before, longer ones are seen later."""
    c = J.source(spark, sf, "conversations")
    ms = F.lit(BASE_MS) + F.col("conv_id") * 10_000 + F.col("turn") * 300 + F.length("text") % 7 * 150
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") / 2).cast("int").cast("string"))
    rows = c.select(key.alias("key"), F.col("turn").cast("long").alias("id"), F.timestamp_millis(ms).alias("at"), F.concat_ws(":", "role", F.md5("text")).alias("value"))
    with O.rocks(spark):
        return J.run(O.messages(rows, "1 minute"), "append")


def stream_drafts(spark, sf):
    """Events as edits, an hour as a second."""
    e = J.source(spark, sf, "events")
    at = F.timestamp_millis((F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000).cast("long"))
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), at.alias("at"), F.col("event_type").alias("value"))
    with O.rocks(spark):
        return J.run(O.drafts(rows, "1 minute"), "append")


def _visits(spark, sf, **columns):
    """Events as the rows of a state by account."""
    return J.source(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), *(c.alias(name) for name, c in columns.items()))


def stream_flags(spark, sf):
    return J.run(K.flags(_visits(spark, sf, generating=F.col("event_type").isin("click", "view"))), "append")


def stream_staging(spark, sf):
    """Even events stage their number, odd ones take what is there."""
    return J.run(K.staging(_visits(spark, sf, payload=F.when(F.col("event_id") % 2 == 0, F.col("event_id"))), minutes=60), "append")


def stream_regressions(spark, sf):
    return J.run(K.regressions(_visits(spark, sf, messages=F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 9).cast("long"))), "append")


def stream_history_cap(spark, sf):
    saves = S.histories_of(J.source(spark, sf, "orders")).select("id", "user_id", "is_draft", "created_at")
    return J.run_merged(saves, A.newest_per_class, ("user_id",)).select("id", "user_id", "is_draft")


def extract_formulas(spark, sf):
    return M.formulas(messy(spark, sf))


def delimited_formulas(spark, sf):
    return M.delimited(messy(spark, sf))


def grid_tables(spark, sf):
    return T.grid_tables(S.gridded(spark, sf))


def paginate(spark, sf):
    return M.paginate(messy(spark, sf))


QUERIES = {f.__name__: f for f in (stream_usage_daily, stream_sessions, stream_failures, stream_new_messages, stream_drafts, stream_flags, stream_staging, stream_regressions, stream_history_cap, extract_formulas, delimited_formulas, grid_tables, paginate)}

_NL = f"'{NL}'"
ORACLES = {
    "stream_usage_daily": "SELECT CAST(ts AS DATE) AS day, CASE WHEN user_id % 3 = 0 THEN 'anon' ELSE 'user' END AS kind, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM n GROUP BY user_id, k""",
    "stream_failures": """WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'), w AS (SELECT user_id, (us // 300000000 - unnest([0, 1, 2])) * 300000000 AS start_us FROM e)
      SELECT user_id, start_us, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2""",
    "stream_new_messages": f"""WITH m AS (SELECT conv_id || ':' || (turn // 2) AS key, turn::BIGINT AS id, {BASE_MS} + conv_id * 10000 + turn * 300 + length(text) % 7 * 150 AS ms, role || ':' || md5(text) AS value FROM conversations),
      q AS (SELECT *, lead(ms) OVER (PARTITION BY key ORDER BY ms, id) AS next, max(ms) OVER () - 60000 AS mark FROM m)
      SELECT key, id, value FROM q WHERE coalesce(next, mark) >= ms + 400 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms, id) = 1""",
    "stream_drafts": """WITH m AS (SELECT user_id::VARCHAR AS key, event_id AS id, epoch_us(ts) // 3600000 AS ms, event_type AS value FROM events),
      q AS (SELECT *, lead(ms) OVER (PARTITION BY key ORDER BY ms, id) AS next, max(ms) OVER () - 60000 AS mark FROM m),
      t AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY ms, id) AS before FROM q WHERE coalesce(next, mark) >= ms + 1500)
      SELECT key, id, value FROM t WHERE before IS DISTINCT FROM value""",
    "stream_flags": """SELECT key, id, generating FROM (SELECT user_id AS key, event_id AS id, event_type IN ('click', 'view') AS generating, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
      WHERE generating <> (coalesce(was, '') IN ('click', 'view'))""",
    "stream_staging": """WITH e AS (SELECT *, lag(ts) OVER w AS staged_at, lag(event_id) OVER w AS staged FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT user_id AS key, event_id AS id, CASE WHEN staged % 2 = 0 AND ts <= staged_at + INTERVAL 1 HOUR THEN staged END AS payload FROM e WHERE event_id % 2 = 1""",
    "stream_regressions": """WITH e AS (SELECT user_id AS key, event_id AS id, ts, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 9 END AS m FROM events),
      l AS (SELECT *, last_value(nullif(m, 0) IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) SELECT key, id, before FROM l WHERE m = 0 AND before >= 5""",
    "stream_history_cap": f"WITH {S.HISTORIES_SQL} SELECT id, user_id, is_draft FROM histories QUALIFY row_number() OVER (PARTITION BY user_id, is_draft ORDER BY created_at DESC, id DESC) <= 10",
    "delimited_formulas": rf"""WITH {MESSY_SQL} SELECT doc_id, true AS is_block, unnest(regexp_extract_all(text, '(?s)\\{{1,2}}\[(.+?)\\{{1,2}}\]', 1)) AS formula FROM messy
      UNION ALL SELECT doc_id, false, unnest(regexp_extract_all(text, '\\{{1,2}}\(([^\n\r]+?)\\{{1,2}}\)', 1)) FROM messy""",
    "grid_tables": f"""WITH {S.GRID_SQL}, lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, {_NL}) AS l FROM gridded)), {Q.fenced("ticks")},
      g AS (SELECT *, NOT in_fence AND regexp_matches(line, '{T.GRID_BORDER}') AS border, NOT in_fence AND regexp_matches(line, '{T.GRID_CONTENT}') AS content FROM f),
      r AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, border OR content ORDER BY line_no) AS run FROM g),
      c AS (SELECT doc_id, run, line_no, list_transform(string_split(regexp_replace({Q.trim("line")}, '^[|]|[|]$', '', 'g'), '|'), lambda x: {Q.trim("x")}) AS cells FROM r WHERE content),
      n AS (SELECT doc_id, run, count(*) FILTER (WHERE content) AS n, count(*) AS whole FROM r WHERE border OR content GROUP BY 1, 2),
      w AS (SELECT doc_id, run, max(len(cells)) AS width, min(line_no) AS first FROM c GROUP BY 1, 2)
      SELECT c.doc_id, c.line_no, '| ' || array_to_string(list_concat(cells, list_transform(range(len(cells), width), lambda x: '')), ' | ') || ' |' AS text, CASE WHEN line_no = first THEN '|' || repeat('---|', width::INT) END AS separator
      FROM c JOIN w USING (doc_id, run) JOIN n USING (doc_id, run) WHERE n.n >= 2 AND n.n < n.whole""",
    "extract_formulas": f"""WITH {MESSY_SQL}, a AS (SELECT doc_id, regexp_split_to_array(text, '{M.BLOCK}') AS p, regexp_extract_all(text, '{M.BLOCK}') AS b FROM messy), k AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS part, unnest(b) AS block FROM a),
      s AS (SELECT *, 1 + coalesce(sum(length(part) - length(replace(part, {_NL}, '')) + coalesce(length(block) - length(replace(block, {_NL}, '')), 0)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k WHERE part IS NOT NULL),
      i AS (SELECT doc_id, start, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, start, string_split(part, {_NL}) AS l FROM s)), m AS (SELECT doc_id, start + i AS line, unnest(regexp_extract_all(x, '{M.INLINE}')) AS m FROM i)
      SELECT doc_id, start + length(part) - length(replace(part, {_NL}, '')) AS line, true AS is_block, substr(block, 3, length(block) - 4) AS formula FROM s WHERE block IS NOT NULL
      UNION ALL SELECT doc_id, line, false, substr(m, 2, length(m) - 2) FROM m""",
}
