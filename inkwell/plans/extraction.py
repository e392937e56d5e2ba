"""Queries over pages and conversations, names and layout, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import extraction as X
from ..operators import layout as Y
from ..operators import naming as N
from ..operators.documents import HEADING_LINE
from ..sources.messy import MESSY_SQL, NL, messy
from ..sources.tables import read
from . import sqltext as Q
from .accounts import values
from .structure import HEAD

PASTE = "对话：https://chat.deepseek.com/share/a%d。 请看，www.kimi.com/x; junk chatgpt.com/share/%d) https://www.example.org/en/%d?x=1!"


def page_quality(spark, sf):
    return X.page_quality(read(spark, sf, "pages"))


def visible_text_len(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.length(X.visible(F.col("html"))).alias("n"))


def page_title(spark, sf):
    return X.titles(read(spark, sf, "pages"))


def _urls(spark, sf):
    hosts = F.array(*(F.lit(h) for _, h in X.HOSTS))
    host = F.get(hosts, (F.col("page_id") % (len(X.HOSTS) + 3)).cast("int"))
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.when(host.isNull(), F.col("url")).otherwise(F.concat(F.when(F.col("page_id") % 2 == 0, "https://").otherwise("https://sub."), host, F.lit("/share/1"))).alias("url"))


def platform_of_url(spark, sf):
    return X.platforms(_urls(spark, sf), spark.createDataFrame(X.HOSTS, "platform string, host string"))


def link_split(spark, sf):
    parts = PASTE.split("%d")
    text = F.concat(F.lit(parts[0]), *(x for p in parts[1:] for x in (F.col("page_id").cast("string"), F.lit(p))))
    return X.links(read(spark, sf, "pages").select(F.col("page_id").alias("id"), text.alias("text")))


def _messages(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def normal_roles(spark, sf):
    rows = _messages(spark, sf).withColumn("r", X.role(F.when(F.col("turn") % 5 == 4, "Model").when(F.col("turn") % 7 == 6, "critic").otherwise(F.col("role"))))
    return rows.where("r IS NOT NULL").groupBy("r").agg(F.count("*").alias("n"))


def merge_adjacent(spark, sf):
    rows = _messages(spark, sf).withColumn("role", F.when((F.col("role") == "system") | (F.col("turn") % 3 == 1), "user").otherwise(F.col("role")))
    return X.merge_adjacent(rows)


def _marked(spark, sf):
    """Messages without system ones; some texts start with headings."""
    head = F.when(F.col("turn") % 3 == 1, "# Top\n## Sub\n").when(F.col("turn") % 3 == 2, "##### Deep\n").otherwise("")
    return _messages(spark, sf).where("role <> 'system'").withColumn("text", F.concat(head, "text"))


def chatdoc_dialogue(spark, sf):
    return X.dialogue(_marked(spark, sf)).withColumn("markdown", F.md5("markdown"))


def chatdoc_article(spark, sf):
    return X.article(_marked(spark, sf)).withColumn("markdown", F.md5("markdown"))


def chatdoc_qa(spark, sf):
    return X.question_answer(_marked(spark, sf)).withColumn("markdown", F.md5("markdown"))


def demote_headings(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", X.demote(F.col("text"), 2).alias("text"))


def conversation_markdown(spark, sf):
    titles = _messages(spark, sf).groupBy("conv_id").agg(F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))).alias("title"))
    return X.conversation_markdown(_marked(spark, sf), titles).withColumn("markdown", F.md5("markdown"))


def last_answer(spark, sf):
    return X.last_answer(_messages(spark, sf))


def message_stats(spark, sf):
    """Counters over the messages of each conversation, by role."""
    rows = _marked(spark, sf)
    return rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.sum(F.regexp_count("text", F.lit(r"(?m)^#+ "))).alias("headings"))


def distinct_sources(spark, sf):
    rows = read(spark, sf, "pages").select(F.expr("page_id DIV 100").alias("conv_id"), F.col("page_id").alias("place"), F.when(F.col("page_id") % 9 == 0, "mailto:x").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 2 == 0, "").otherwise("site").alias("text"))
    return X.sources(rows)


def first_heading(spark, sf):
    return N.first_headings(messy(spark, sf))


def safe_filename(spark, sf):
    docs = messy(spark, sf)
    return N.file_names(docs, docs.where("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("a/b: "), F.left("text", F.lit(70)), F.lit(" ..")).alias("title")))


def history_title(spark, sf):
    return N.history_titles(messy(spark, sf))


def zip_names(spark, sf):
    name = F.concat(F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.concat(F.lit("re:port "), (F.col("doc_id") % 30).cast("string"), F.when(F.col("doc_id") % 13 == 0, "(2)").when(F.col("doc_id") % 17 == 0, "(3)(2)").otherwise(""))), F.lit(".MD"))
    return N.zip_names(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), name.alias("name")))


def batch_sources(spark, sf):
    """Files of a batch: the wanted extensions, the first of a name, later ones counted as skipped."""
    ext = F.when(F.col("doc_id") % 4 == 0, ".md").when(F.col("doc_id") % 4 == 1, ".TXT").when(F.col("doc_id") % 4 == 2, ".markdown").otherwise(".pdf")
    rows = read(spark, sf, "documents").select("doc_id", F.concat((F.col("doc_id") % 50).cast("string"), ext).alias("name")).where(F.col("name").rlike(N.ZIP_EXT))
    return rows.groupBy("name").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("skipped"))


def heading_numbers(spark, sf):
    return Y.heading_numbers(messy(spark, sf))


def split_count(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", Y.split_count(F.col("l_quantity").cast("int") % 9, F.col("l_linenumber") - 1).alias("k"))


def toc_pages(spark, sf):
    rows = Y.heading_numbers(messy(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("entries"))
    return rows.select("doc_id", Y.toc_pages(F.col("entries") * 20, 842.0).alias("pages"))


def column_balance(spark, sf):
    p = read(spark, sf, "part")
    cells = p.select((F.col("p_partkey") % 100).alias("table_id"), F.stack(F.lit(4), F.lit(0), "p_name", F.lit(1), "p_brand", F.lit(2), F.concat("p_type", F.lit("中文")), F.lit(3), F.col("p_size").cast("string")).alias("col", "text"))
    return Y.column_balance(cells)


def units_convert(spark, sf):
    """Page sizes and margins in points and pixels."""
    rows = spark.createDataFrame([(k, w, h) for k, (w, h) in Y.PAPER.items()], "paper string, w int, h int").crossJoin(spark.createDataFrame([(True,), (False,)], "landscape boolean"))
    width, height = F.when(F.col("landscape"), F.col("h")).otherwise(F.col("w")), F.when(F.col("landscape"), F.col("w")).otherwise(F.col("h"))
    return rows.select("paper", "landscape", (width / 20).alias("width_pt"), (height / 20).alias("height_pt"), F.floor(width / 15 + 0.5).alias("width_px"), F.floor(F.lit(25.4) * 56.6929 + 0.5).alias("inch_twips"))


QUERIES = {f.__name__: f for f in (
    page_quality, visible_text_len, page_title, platform_of_url, link_split, normal_roles, merge_adjacent, chatdoc_dialogue, chatdoc_article, chatdoc_qa, demote_headings, conversation_markdown, last_answer, message_stats,
    distinct_sources, first_heading, safe_filename, history_title, zip_names, batch_sources, heading_numbers, split_count, toc_pages, column_balance, units_convert,
)}

VISIBLE = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{X.SCRIPT}', ' ', 'g'), '{X.STYLE}', ' ', 'g'), '{X.TAG}', ' ', 'g'), '[{WS}]+', '', 'g')"
MARKED = f"""m AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 1 THEN '# Top{NL}## Sub{NL}' WHEN 2 THEN '##### Deep{NL}' ELSE '' END || text AS text FROM conversations WHERE role <> 'system')"""
_PASTE = " || page_id || ".join(f"'{p}'" for p in PASTE.split("%d"))


def demoted(x: str, levels: int) -> str:
    for n in range(6, 0, -1):
        x = f"regexp_replace({x}, '(?m)^#{{{n}}}([{WS}])', repeat(chr(1), {min(6, n + levels)}) || '\\1', 'g')"
    return f"replace({x}, chr(1), '#')"


def bare(x: str) -> str:
    return Q.trim(f"regexp_replace(regexp_replace(regexp_replace({x}, '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`~]', '', 'g')")


def safe(x: str) -> str:
    return Q.trim(f"left(regexp_replace(regexp_replace(regexp_replace({x}, '{N.ILLEGAL}', ' ', 'g'), '[{WS}]+', ' ', 'g'), '^[.{WS}]+|[.{WS}]+$', '', 'g'), 60)")


FIRST = f"fh AS (SELECT doc_id, {bare(f'''regexp_extract(arg_min(line, line_no), '{N.ATX}', 1)''')} AS heading FROM f WHERE NOT in_fence AND regexp_matches(line, '{N.ATX}') GROUP BY 1)"

NUMBERS = f"""{HEAD}, h0 AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#+)', 1)) AS level FROM f WHERE NOT in_fence AND regexp_matches(line, '{HEADING_LINE}')), h AS (SELECT * FROM h0 WHERE level <= 3),
  a AS (SELECT *, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS h1 FROM h), b AS (SELECT *, count(*) FILTER (WHERE level = 2) OVER (PARTITION BY doc_id, h1 ORDER BY line_no) AS h2 FROM a),
  c AS (SELECT *, count(*) FILTER (WHERE level = 3) OVER (PARTITION BY doc_id, h1, h2 ORDER BY line_no) AS h3 FROM b),
  hn AS (SELECT doc_id, line_no, level, CASE level WHEN 1 THEN h1::VARCHAR WHEN 2 THEN h1 || '.' || h2 ELSE h1 || '.' || h2 || '.' || h3 END AS number FROM c)"""

ORACLES = {
    "page_quality": f"""WITH a AS (SELECT page_id, html, left(html, 6000) AS head, length({VISIBLE}) AS n FROM pages), b AS (SELECT *, {Q.trim(f"regexp_extract(head, '{X.TITLE}', 1)")} AS title FROM a)
      SELECT page_id, CASE WHEN regexp_matches(title, '{X.CHALLENGE}') OR (regexp_matches(head, '{X.CHALLENGE}') AND length(html) < 200000 AND n < 1500) THEN 'challenge' WHEN regexp_matches(title, '{X.LOGIN_TITLE}') OR (regexp_matches(head, '{X.LOGIN_TEXT}') AND n < 1200) THEN 'login'
        WHEN n < 200 AND NOT regexp_matches(html, '{X.EMBEDDED}') THEN 'shell' ELSE 'ok' END AS verdict FROM b""",
    "visible_text_len": f"SELECT page_id, length({VISIBLE}) AS n FROM pages",
    "page_title": f"""SELECT page_id, left(regexp_replace({Q.trim(f"coalesce(nullif(regexp_extract(html, '{X.OG_TITLE}', 1), ''), regexp_extract(html, '{X.TITLE}', 1))")}, '{X.TITLE_TAIL}', ''), 120) AS title FROM pages""",
    "platform_of_url": f"""WITH hosts AS (SELECT * FROM {values(X.HOSTS, "platform, host")}), n AS (SELECT * FROM {values([(i, h) for i, (_, h) in enumerate(X.HOSTS)], "i, host")}),
      u AS (SELECT page_id AS id, lower(regexp_extract(CASE WHEN n.host IS NULL THEN url ELSE CASE WHEN page_id % 2 = 0 THEN 'https://' ELSE 'https://sub.' END || n.host || '/share/1' END, '(?i)^(?:https?://)?([^/?#:]+)', 1)) AS host FROM pages LEFT JOIN n ON n.i = page_id % {len(X.HOSTS) + 3})
      SELECT id, min(platform) AS platform FROM u JOIN hosts h ON u.host = h.host OR ends_with(u.host, '.' || h.host) GROUP BY 1""",
    "link_split": f"""WITH t AS (SELECT page_id AS id, regexp_split_to_array({_PASTE}, '[{WS}，,；;]+') AS l FROM pages), k AS (SELECT id, unnest(range(0, len(l))) AS place, unnest(l) AS token FROM t),
      u AS (SELECT id, place, regexp_replace(CASE WHEN regexp_extract(token, '({X.LINK})', 1) <> '' THEN regexp_extract(token, '({X.LINK})', 1) ELSE token END, '{X.NOISE.replace(chr(39), chr(39) * 2)}', '') AS url FROM k) SELECT * FROM u WHERE regexp_matches(url, '{X.URL_START}')""",
    "normal_roles": """WITH a AS (SELECT lower(CASE WHEN turn % 5 = 4 THEN 'Model' WHEN turn % 7 = 6 THEN 'critic' ELSE role END) AS x FROM conversations),
      b AS (SELECT CASE WHEN x IN ('user', 'human') THEN 'user' WHEN x IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' WHEN x IN ('system', 'tool', 'function') THEN NULL ELSE 'unknown' END AS r FROM a) SELECT r, count(*) AS n FROM b WHERE r IS NOT NULL GROUP BY 1""",
    "merge_adjacent": f"""WITH a AS (SELECT conv_id, turn, CASE WHEN role = 'system' OR turn % 3 = 1 THEN 'user' ELSE role END AS role, text FROM conversations), b AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM a),
      c AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM b) SELECT conv_id, part, role, count(*) AS turns, string_agg(text, '{NL}{NL}' ORDER BY turn) AS content FROM c GROUP BY 1, 2, 3""",
    "chatdoc_dialogue": f"""WITH {MARKED} SELECT conv_id, md5(string_agg('### ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'AI' ELSE 'Message' END || '{NL}{NL}' || {demoted(Q.trim("text"), 2)}, '{NL}{NL}' ORDER BY turn)) AS markdown FROM m GROUP BY 1""",
    "chatdoc_article": f"""WITH {MARKED}, a AS (SELECT conv_id, turn, CASE WHEN regexp_matches({Q.trim("text")}, '(?m)^#[{WS}]') THEN {demoted(Q.trim("text"), 1)} ELSE {Q.trim("text")} END AS p FROM m WHERE role = 'assistant') SELECT conv_id, md5(string_agg(p, '{NL}{NL}' ORDER BY turn)) AS markdown FROM a WHERE p <> '' GROUP BY 1""",
    "chatdoc_qa": f"""WITH {MARKED}, a AS (SELECT conv_id, arg_min({Q.trim("text")}, turn) FILTER (WHERE role = 'user') AS q, arg_min({Q.trim("text")}, turn) FILTER (WHERE role = 'assistant') AS a FROM m GROUP BY 1)
      SELECT conv_id, md5(concat_ws('{NL}{NL}', '## Question{NL}{NL}' || q, '## Answer{NL}{NL}' || {demoted("a", 1)})) AS markdown FROM a""",
    "demote_headings": f"WITH {MARKED} SELECT conv_id, turn, {demoted('text', 2)} AS text FROM m",
    "conversation_markdown": f"""WITH {MARKED}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM m), b AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '### User' WHEN 'assistant' THEN '### AI' ELSE '### Message' END || ' (' || n || '){NL}{NL}' || {Q.trim("text")}, '{NL}{NL}' ORDER BY turn) AS body FROM n GROUP BY 1)
      SELECT conv_id, md5('# ' || CASE WHEN conv_id % 4 = 0 THEN 'Conversation' ELSE 'Talk ' || conv_id END || '{NL}{NL}> Source: shared link, imported 2024-01-31{NL}{NL}' || body) AS markdown FROM b""",
    "last_answer": """WITH a AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT a.conv_id, a.turn, (SELECT max(c.turn) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn AND c.role = 'user') AS question FROM a""",
    "message_stats": f"""WITH {MARKED} SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, sum({Q.count("text", "(?m)^#+ ")})::BIGINT AS headings FROM m GROUP BY 1""",
    "distinct_sources": """WITH a AS (SELECT page_id // 100 AS conv_id, page_id AS place, CASE WHEN page_id % 9 = 0 THEN 'mailto:x' ELSE url END AS url, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'site' END AS text FROM pages),
      b AS (SELECT conv_id, url, min(place) AS place, arg_min(text, place) AS text FROM a WHERE regexp_matches(url, '(?i)^https?:') GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, url) AS n FROM b)
      SELECT conv_id, n, '[' || coalesce(nullif(text, ''), url) || '](' || url || ')' AS link FROM c WHERE n <= 50""",
    "first_heading": f"WITH {HEAD}, {FIRST} SELECT * FROM fh",
    "safe_filename": f"""WITH {HEAD}, {FIRST} SELECT m.doc_id, coalesce(nullif({safe("CASE WHEN m.doc_id % 5 = 0 THEN 'a/b: ' || left(m.text, 70) || ' ..' END")}, ''), nullif({safe("fh.heading")}, ''), 'Document-2024-01-31') AS name FROM messy m LEFT JOIN fh USING (doc_id)""",
    "history_title": f"""WITH {MESSY_SQL}, a AS (SELECT doc_id, list_filter(list_transform(string_split(text, '{NL}'), lambda x: {Q.trim(f"regexp_replace(regexp_replace(x, '^#{{1,6}}[{WS}]+', ''), '[*`>]', '', 'g')")}), lambda x: x <> '')[1] AS t FROM messy)
      SELECT doc_id, CASE WHEN t IS NULL THEN 'Untitled' WHEN length(t) > 40 THEN left(t, 40) || '…' ELSE t END AS title FROM a""",
    "zip_names": f"""WITH RECURSIVE a AS (SELECT doc_id AS id, left(coalesce(nullif({Q.trim(f"regexp_replace(regexp_replace(CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE 're:port ' || (doc_id % 30) || CASE WHEN doc_id % 13 = 0 THEN '(2)' WHEN doc_id % 17 = 0 THEN '(3)(2)' ELSE '' END END || '.MD', '{N.ZIP_EXT}', ''), '{N.ILLEGAL}', '_', 'g')")}, ''), 'untitled'), 80) AS stem FROM documents),
      o AS (SELECT *, regexp_replace(stem, '(\\([0-9]+\\))+$', '') AS family FROM a), p AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY id) AS k FROM o),
      r(family, k, id, entry, used) AS (SELECT family, k, id, stem, [stem] FROM p WHERE k = 1
        UNION ALL SELECT family, k, id, entry, list_append(used, entry) FROM (SELECT p.family, p.k, p.id, r.used, CASE WHEN list_contains(r.used, p.stem)
            THEN p.stem || '(' || list_filter(range(2, len(r.used) + 3), lambda n: NOT list_contains(r.used, p.stem || '(' || n || ')'))[1] || ')' ELSE p.stem END AS entry FROM r JOIN p ON p.family = r.family AND p.k = r.k + 1))
      SELECT id, entry || '.docx' AS entry FROM r""",
    "batch_sources": f"""WITH a AS (SELECT doc_id, (doc_id % 50) || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.markdown' ELSE '.pdf' END AS name FROM documents) SELECT name, min(doc_id) AS doc_id, count(*) - 1 AS skipped FROM a WHERE regexp_matches(name, '{N.ZIP_EXT}') GROUP BY 1""",
    "heading_numbers": f"WITH {NUMBERS} SELECT * FROM hn",
    "split_count": """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity::INT % 9 AS t, l_linenumber - 1 AS m FROM lineitem), b AS (SELECT *, least(m, t) AS k FROM a), c AS (SELECT *, CASE WHEN t - k = 1 AND k > 1 THEN k - 1 ELSE k END AS s FROM b)
      SELECT l_orderkey, l_linenumber, CASE WHEN t <= 0 OR m <= 0 THEN 0 WHEN k >= t THEN k WHEN s = 1 AND t > 1 THEN 0 ELSE s END AS k FROM c""",
    "toc_pages": f"WITH {NUMBERS} SELECT doc_id, greatest(1, ceil((70 + 30 * 20 * count(*)) / 842.0))::BIGINT AS pages FROM hn GROUP BY 1",
    "column_balance": f"""WITH c AS (SELECT p_partkey % 100 AS table_id, unnest([0, 1, 2, 3]) AS col, unnest([p_name, p_brand, p_type || '中文', p_size::VARCHAR]) AS text FROM part),
      w AS (SELECT table_id, col, max(least(length(text) + {Q.count("text", Y.WIDE_CHARS)}, 80)) AS w FROM c GROUP BY 1, 2), a AS (SELECT *, 50.0::DOUBLE / count(*) OVER t AS fl, greatest(100.0::DOUBLE * w / sum(w) OVER t, 50.0::DOUBLE / count(*) OVER t) AS p FROM w WINDOW t AS (PARTITION BY table_id)),
      b AS (SELECT *, sum(p) OVER t - 100 AS ov, sum(p - fl) OVER t AS su FROM a WINDOW t AS (PARTITION BY table_id)) SELECT table_id, col, round(CASE WHEN ov <= 1e-9 THEN p WHEN su > ov THEN fl + (p - fl) * (su - ov) / su ELSE p * 100 / (ov + 100) END, 2) AS pct FROM b""",
    "units_convert": f"""WITH p AS (SELECT * FROM {values([(k, w, h) for k, (w, h) in Y.PAPER.items()], "paper, w, h")}), l AS (SELECT unnest([true, false]) AS landscape), a AS (SELECT paper, landscape, CASE WHEN landscape THEN h ELSE w END AS x, CASE WHEN landscape THEN w ELSE h END AS y FROM p, l)
      SELECT paper, landscape, x / 20::DOUBLE AS width_pt, y / 20::DOUBLE AS height_pt, floor(x / 15::DOUBLE + 0.5)::BIGINT AS width_px, floor(25.4 * 56.6929 + 0.5)::BIGINT AS inch_twips FROM a""",
}
