"""Queries over broken formulas, diagrams, papers and links, over imports, and over the export quota, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import embedded as E
from ..operators import imports as I
from ..operators import quota as U
from ..operators import wordfix as W
from ..operators.lines import lines
from ..sources import tables as S
from ..sources.messy import NL, quote
from . import sqltext as Q

T = "```"
#: What stands before a document's text, by its number.
HEADS = [
    f"∑_(k=0)^m▒a_k\n水深约 ωt^(3) 尺，其中 h_(m+2)≤w。\n{T}\nx_(1)\n{T}\n$$\nx_(2)\n$$\nsee `y_(2)` and $z_(3)$\nu_(v_(w)) αb ≤ 3\n没有公式\n",
    "\\begin{cases}\np \\\\ q\n\\end{cases}\n$$\n\\begin{matrix}\n1\n\\end{matrix}\n$$\n \\begin{pmatrix} 1 \\end{pmatrix}\n\\begin{aligned}\n\\begin{split}\n2\n\\end{split}\n\\end{aligned}\n\\begin{align*}\nopen\n",
    f"graph LR\nin --> out\nout --> end\n\na --> b\nc ==> d\n- e --> f\ngantt\n\ng --> h\npie\ni ->> j\n{T}\ngraph TD\nk --> l\n{T}\nx\nm --> n\no --> p\nflowchart\n",
    "# A study of rivers\n## Field notes\n摘要：水位与流速\n## Methods\n### Gauges\n#### Zero point\n### Boats\n—— 之一\n- list row\n## Results\n### Flood\n## 参考文献\n[1] Someone\n- Another\n# Annex\n## More\n",
    "see https://maps.example.org/river_(north)). and www.boats.example.org/a?b=1, or (https://no.example.org) <https://no.example.net>\n水位 https://level.example.org/今天 https://x.example.org/(a)(b)!!\n",
]


def broken(spark, sf):
    head = reduce(lambda c, i: c.when(F.col("doc_id") % len(HEADS) == i, HEADS[i]), range(len(HEADS)), F)
    return S.read(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("text"))


def linear_formulas(spark, sf):
    return W.linear_formulas(broken(spark, sf))


def bare_environments(spark, sf):
    return W.bare_environments(broken(spark, sf))


def diagram_runs(spark, sf):
    return W.diagrams(lines(broken(spark, sf)))


def academic_blocks(spark, sf):
    return W.academic(lines(broken(spark, sf)))


def naked_links(spark, sf):
    return W.naked_links(lines(broken(spark, sf)))


def page_messages(spark, sf):
    """Messages of pages that carry conversations in a script, an assigned state or a stream, one script in all being broken."""
    c = S.read(spark, sf, "conversations")
    said = F.to_json(F.array("text"))
    item = F.when(F.col("conv_id") % 3 == 2, F.concat(F.lit('"author":{"role":"'), "role", F.lit('"},"id":"x]","parts":'), said)).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("j")))), lambda s: s.j), ",")
    script = F.concat(F.lit('<script type="application/json">{</script><script id="d" type="application/json">{"list":['), items, F.lit("]}</script>"))
    state = F.concat(F.lit("<script>window.__INITIAL_STATE__ = {\"brace\":\"}\",\"list\":["), items, F.lit("]};</script>"))
    stream = F.concat(F.lit("<script>push("), items, F.lit(")</script>"))
    pages = c.groupBy("conv_id").agg(F.when(F.col("conv_id") % 3 == 0, script).when(F.col("conv_id") % 3 == 1, state).otherwise(stream).alias("html"))
    return E.page_messages(pages).withColumn("text", F.md5("text"))


def _attempts(spark, sf):
    e = S.read(spark, sf, "events")
    anon = F.col("user_id") % 3 == 0
    return e.select(
        F.col("event_id").alias("id"), F.when(~anon, F.col("user_id")).alias("user_id"), F.when(anon, F.col("user_id")).alias("device_id"),
        F.concat(F.expr("user_id DIV 12").cast("string"), F.lit("."), (F.col("event_id") % 2).cast("string")).alias("ip"),
        F.when(F.col("event_type") == "error", "txt").when(F.col("event_type") == "purchase", "pdf").otherwise("docx").alias("format"), (F.col("event_id") % 13 == 0).alias("check_only"), F.col("ts").alias("created_at"),
    )


def export_quota(spark, sf):
    accounts = S.profiles(spark, sf).select("id", F.when(F.col("id") % 17 == 0, "deleted").otherwise(F.col("status")).alias("status"), (F.col("id") % 110).alias("exports"))
    return U.decide(_attempts(spark, sf), accounts)


def import_items(spark, sf):
    p = S.read(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    return I.import_items(p.select(F.expr("page_id DIV 50").alias("id"), F.col("page_id").alias("place"), F.when(F.col("page_id") % 3 == 0, F.upper(host)).when(F.col("page_id") % 3 == 1, F.concat(host, F.lit("/"))).otherwise(F.col("url")).alias("url")))


def import_totals(spark, sf):
    c = S.read(spark, sf, "conversations")
    one = c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n\n").alias("markdown"))
    return I.import_totals(one.select(F.expr("conv_id DIV 5").alias("id"), F.col("conv_id").alias("place"), "messages", "markdown")).withColumn("markdown", F.md5("markdown"))


def import_replay(spark, sf):
    return I.replay(S.histories(spark, sf).where("is_draft"))


def notice_order(spark, sf):
    rows = S.read(spark, sf, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("place"), F.col("event_type").alias("notice"))
    return I.notices(rows).select("id", F.array_join("notices", ",").alias("notices"))


def platform_titles(spark, sf):
    p = S.read(spark, sf, "part")
    title = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, F.concat(F.upper("p_brand"), F.lit(" x"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", I.platform_title(title, F.col("p_brand")).alias("title"))


def fingerprints(spark, sf):
    c, key = S.read(spark, sf, "customer"), F.col("c_custkey")
    zone = F.when(key % 4 > 0, F.col("c_mktsegment"))
    return c.select("c_custkey", F.sha2(I.fingerprint(F.col("c_name"), F.lit("en"), key * 10, key * 7, F.lit(24), zone, F.when(key % 3 > 0, key % 16), F.lit(None).cast("int")), 256).alias("fingerprint"))


def soft_delete(spark, sf):
    """Accounts by status after deletions, with the histories that are left."""
    accounts, kept = I.erased(S.profiles(spark, sf), S.histories(spark, sf), F.col("id") % 7 == 0, F.col("id") % 11 == 0)
    left = kept.groupBy("user_id").agg(F.count("*").alias("n"))
    return accounts.join(left, accounts["id"] == left["user_id"], "left").groupBy("status").agg(F.count("*").alias("accounts"), F.coalesce(F.sum("n"), F.lit(0)).alias("histories"))


QUERIES = {f.__name__: f for f in (
    linear_formulas, bare_environments, diagram_runs, academic_blocks, naked_links, page_messages, export_quota, import_items, import_totals, import_replay, notice_order, platform_titles, fingerprints, soft_delete,
)}


_CASES = " ".join(f"WHEN {i} THEN {quote(h)}" for i, h in enumerate(HEADS))
LINES = f"""broken AS (SELECT doc_id, (CASE doc_id % {len(HEADS)} {_CASES} END) || text AS text FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, '{NL}') AS l FROM broken))"""
_SO_FAR = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
ACTIVE = f"""{LINES}, {Q.fenced("ticks_or_tildes")},
d AS (SELECT *, CASE WHEN in_fence THEN 0 ELSE {Q.count(f"({Q.without_code('line')})", "[$][$]")} END AS delims FROM f),
a AS (SELECT *, NOT in_fence AND NOT (sum(delims) {_SO_FAR} % 2 = 1 AND delims = 0) AS active FROM d)"""
_KEYS = "[" + ", ".join(map(quote, W.SYMBOLS)) + "]"
_NAMES = "[" + ", ".join(map(quote, W.SYMBOLS.values())) + "]"


def _latex(x: str) -> str:
    x = f"replace({x}, '▒', ' ')"
    for _ in range(2):
        x = f"regexp_replace(regexp_replace({x}, '_\\(([^()]*)\\)', '_{{\\1}}', 'g'), '\\^\\(([^()]*)\\)', '^{{\\1}}', 'g')"
    # a name of letters gets a blank where a letter follows, which the marker stands for
    x = f"list_transform(string_split({x}, ''), lambda c: coalesce(({_NAMES})[list_position({_KEYS}, c)] || chr(1), c))"
    return f"replace(regexp_replace(array_to_string({x}, ''), '([a-zA-Z])\\x01([a-zA-Z])', '\\1 \\2', 'g'), chr(1), '')"


_URL = W._URL
ORACLES = {
    "linear_formulas": f"""WITH {ACTIVE}, b AS (SELECT doc_id, line_no, line, regexp_replace(regexp_replace({Q.without_code("line")}, '[$][$][^$]*[$][$]', '', 'g'), '[$][^$\\n]+[$]', '', 'g') AS bare FROM a WHERE active),
      w AS (SELECT *, {Q.trim(_latex("bare"))} AS whole, string_split_regex(line, '{W.RUN}') AS p, regexp_extract_all(line, '{W.RUN}') AS r FROM b WHERE regexp_matches(bare, '{W.LINEAR}')),
      z AS (SELECT *, list_transform(r, lambda x: CASE WHEN regexp_matches(x, '{W.LINEAR}') THEN '$' || {Q.trim(_latex("x"))} || '$' ELSE x END) AS q FROM w),
      g AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '[\u4e00-\u9fff]') THEN array_to_string(list_transform(p, lambda x, i: x || coalesce(q[i], '')), '')
        WHEN whole = '' THEN line WHEN starts_with(whole, '$$') THEN whole ELSE '$$' || whole || '$$' END AS fixed FROM z) SELECT * FROM g WHERE fixed <> line""",
    "bare_environments": f"""WITH {ACTIVE}, n AS (SELECT doc_id, line_no, line, active, regexp_extract({Q.trim("line")}, '{W.ENVIRONMENT}', 1) AS name FROM a),
      s AS (SELECT doc_id, line_no AS first_line, name FROM n WHERE active AND name <> ''),
      e AS (SELECT s.doc_id, first_line, s.name, min(l.line_no) AS last_line FROM s JOIN lines l ON l.doc_id = s.doc_id AND l.line_no >= first_line AND contains(l.line, '\\end{{' || s.name || '}}') GROUP BY 1, 2, 3),
      k AS (SELECT e.* FROM e WHERE NOT (EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = e.doc_id AND l.line_no = first_line - 1 AND {Q.trim("l.line")} = '$$') AND EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = e.doc_id AND l.line_no = last_line + 1 AND {Q.trim("l.line")} = '$$')))
      SELECT doc_id, first_line, last_line, name FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.doc_id = k.doc_id AND o.first_line < k.first_line AND o.last_line >= k.first_line)""",
    "diagram_runs": f"""WITH {LINES}, {Q.fenced("ticks_or_tildes")},
      h AS (SELECT doc_id, line_no, regexp_matches({Q.trim("line")}, '{W.DIAGRAM.replace(chr(92) + "z", "$")}') AS head, regexp_matches(line, '{W.ARROW}') AS arrow, NOT in_fence AND NOT regexp_matches({Q.trim_start("line")}, '{W.NO_DIAGRAM}') AS plain FROM f),
      r AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM h WHERE plain AND (head OR arrow)),
      c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE arrow) OVER w AS arrows, max(line_no) OVER w AS last_line FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT doc_id, min(line_no) AS first_line, max(last_line) AS last_line FROM c WHERE (head AND n >= 2) OR (n >= 3 AND arrows >= 2) GROUP BY doc_id, run""",
    "academic_blocks": f"""WITH {LINES}, b AS (SELECT doc_id, line_no, line, length(regexp_extract(line, '^(#{{1,4}}) ', 1)) AS level, {Q.trim("regexp_replace(line, '^(#{1,4}|[-*+]|[0-9]+\\.) ', '')")} AS text FROM lines WHERE {Q.trim("line")} <> ''),
      t AS (SELECT *, CASE WHEN level > 0 THEN 'h' WHEN regexp_matches(line, '^([-*+]|[0-9]+\\.) ') THEN 'list' ELSE 'p' END AS tag, row_number() OVER o AS place, count(*) FILTER (WHERE level = 1) OVER o AS titles,
        count(*) FILTER (WHERE level = 2 AND contains(text, '参考文献')) OVER o > 0 AS refs FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
      c AS (SELECT *, CASE WHEN level = 1 THEN CASE WHEN titles = 1 THEN 'title' ELSE '' END WHEN level = 2 AND contains(text, '参考文献') THEN 'ref-title' WHEN level = 2 AND place = 2 AND titles = 1 THEN 'subtitle' WHEN tag = 'h' THEN ''
        WHEN tag = 'list' THEN CASE WHEN refs THEN 'ref-list' ELSE '' END WHEN refs THEN 'ref-item'
        WHEN starts_with(text, '摘要') OR starts_with(text, '关键词') OR contains(text, '**摘要**') OR contains(text, '**关键词**') THEN 'abstract'
        WHEN starts_with(text, '副标题：') OR starts_with(text, '副标题:') OR starts_with(text, '——') THEN 'subtitle-p' ELSE 'p' END AS class FROM t),
      d AS (SELECT *, CASE WHEN level >= 2 AND class NOT IN ('subtitle', 'ref-title') THEN level - 1 END AS deep FROM c),
      n AS (SELECT *, count(*) FILTER (WHERE deep = 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS n1 FROM d), m AS (SELECT *, count(*) FILTER (WHERE deep = 2) OVER (PARTITION BY doc_id, n1 ORDER BY line_no) AS n2 FROM n),
      q AS (SELECT *, count(*) FILTER (WHERE deep = 3) OVER (PARTITION BY doc_id, n1, n2 ORDER BY line_no) AS n3 FROM m)
      SELECT doc_id, line_no, class, CASE deep WHEN 1 THEN n1::VARCHAR WHEN 2 THEN n1 || '.' || n2 WHEN 3 THEN n1 || '.' || n2 || '.' || n3 END AS number FROM q""",
    "naked_links": f"""WITH {LINES}, u AS (SELECT doc_id, line_no, unnest(l) AS url, unnest(range(len(l))) AS n FROM (SELECT doc_id, line_no, regexp_extract_all(line, {quote('(^|[^(<"' + chr(39) + '[=' + chr(92) * 2 + '])(https?://' + _URL + '+|www' + chr(92) + '.' + _URL + '+)')}, 2) AS l FROM lines)),
      p AS (SELECT *, length(regexp_replace(url, {quote(W.TAIL.replace(chr(92) + "z", "$"))}, '')) AS core FROM u),
      k AS (SELECT *, list_max(list_filter(range(core, length(url) + 1), lambda i: i = core OR (url[i:i] = ')' AND length(replace(url[1:i], ')', '')) >= length(replace(url[1:i], '(', ''))))) AS kept FROM p)
      SELECT doc_id, line_no, n, url[1:kept] AS bare, CASE WHEN starts_with(url, 'www.') THEN 'https://' ELSE '' END || url[1:kept] AS href, url[kept + 1:] AS rest FROM k""",
    "page_messages": f"""WITH m AS (SELECT conv_id, turn, CASE WHEN lower(role) IN ('user', 'human') THEN 'user' WHEN lower(role) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' ELSE 'unknown' END AS role, {Q.trim("text")} AS text FROM conversations
        WHERE lower(role) NOT IN ('system', 'tool', 'function') AND (conv_id % 3 < 2 OR role IN ('user', 'human', 'assistant', 'ai')))
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, md5(text) AS text, CASE WHEN conv_id % 3 < 2 THEN 'json' ELSE 'flight' END AS layer FROM m WHERE text <> ''""",
    "export_quota": f"""WITH RECURSIVE {S.PROFILES_SQL},
      t AS (SELECT event_id AS id, user_id AS who, user_id % 3 = 0 AS anon, (user_id // 12) || '.' || (event_id % 2) || ' ' || ts::DATE AS ip_day, event_type = 'error' AS bad, event_id % 13 = 0 AS asks, ts FROM events),
      e AS (SELECT t.*, CASE WHEN bad THEN 'INVALID' WHEN NOT anon AND (p.id IS NULL OR p.id % 17 = 0) THEN 'AUTH_REQUIRED' WHEN NOT anon AND p.status = 'disabled' THEN 'DISABLED' WHEN asks THEN 'ok' END AS early, p.id % 110 AS used FROM t LEFT JOIN profiles p ON NOT anon AND p.id = who),
      q AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS k FROM e WHERE early IS NULL AND anon),
      s(k, passed) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, d BIGINT, a VARCHAR)[] UNION ALL
        SELECT q.k, CASE WHEN len(list_filter(passed, lambda x: x.d = q.who)) < {U.DEVICE} AND len(list_filter(passed, lambda x: x.a = q.ip_day)) < {U.ADDRESS} THEN list_append(passed, {{'id': q.id, 'd': q.who, 'a': q.ip_day}}) ELSE passed END FROM s JOIN q ON q.k = s.k + 1),
      v AS (SELECT unnest(passed).id AS id FROM (SELECT passed FROM s ORDER BY k DESC LIMIT 1) UNION ALL
        SELECT id FROM (SELECT id, used, row_number() OVER (PARTITION BY who ORDER BY ts, id) AS place FROM e WHERE early IS NULL AND NOT anon) WHERE place <= {U.ACCOUNT} - used)
      SELECT e.id, CASE WHEN anon THEN 'anon' ELSE 'user' END AS kind, coalesce(early, CASE WHEN v.id IS NOT NULL THEN 'ok' END, 'QUOTA_EXCEEDED') AS verdict FROM e LEFT JOIN v ON v.id = e.id""",
    "import_items": """WITH h AS (SELECT page_id // 50 AS id, page_id AS place, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS rest, page_id % 3 AS k FROM pages),
      g AS (SELECT id, place, lower(host) || CASE WHEN k < 2 OR rest = '' THEN '/' WHEN rest[1] = '/' THEN rest ELSE '/' || rest END AS href FROM h WHERE host <> '') SELECT id, min(place) AS place, href FROM g GROUP BY id, href""",
    "import_totals": f"""WITH o AS (SELECT conv_id, count(*) AS messages, string_agg(text, '{NL}{NL}' ORDER BY turn, text) AS markdown FROM conversations GROUP BY 1)
      SELECT conv_id // 5 AS id, sum(messages)::BIGINT AS messages, md5(string_agg(markdown, '{NL}{NL}---{NL}{NL}' ORDER BY conv_id)) AS markdown FROM o GROUP BY 1""",
    "import_replay": f"WITH {S.HISTORIES_SQL} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS step, id, title[1:120] AS title FROM histories WHERE is_draft",
    "notice_order": """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), d AS (SELECT user_id, event_type, min(k) AS k FROM r GROUP BY 1, 2)
      SELECT user_id AS id, string_agg(event_type, ',' ORDER BY k) AS notices FROM d GROUP BY 1""",
    "platform_titles": """WITH t AS (SELECT p_partkey, p_brand AS b, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN upper(p_brand) || ' x' ELSE p_name END AS title FROM part)
      SELECT p_partkey, CASE WHEN title = '' THEN b WHEN contains(lower(title), lower(b)) THEN title ELSE b || '-' || title END AS title FROM t""",
    "fingerprints": """SELECT c_custkey, sha256(c_name || '|en|' || (c_custkey * 10) || 'x' || (c_custkey * 7) || 'x24|' || CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END || '|' || CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 16 ELSE 0 END || '|0') AS fingerprint FROM customer""",
    "soft_delete": f"""WITH {S.PROFILES_SQL}, {S.HISTORIES_SQL}, k AS (SELECT user_id, count(*) AS n FROM histories WHERE id % 11 <> 0 GROUP BY 1)
      SELECT CASE WHEN p.id % 7 = 0 THEN 'deleted' ELSE status END AS status, count(*) AS accounts, coalesce(sum(n), 0)::BIGINT AS histories FROM profiles p LEFT JOIN k ON k.user_id = p.id GROUP BY 1""",
}
