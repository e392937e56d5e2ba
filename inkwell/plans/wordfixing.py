"""Queries of whole texts made ready for a word processor, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import INVISIBLE, NBSP, WIDE
from ..operators import wordfix as W
from ..operators import wordfixing as X
from ..operators.lines import MARKERS
from . import sqltext as Q
from .repair import LINES, _latex, broken


def word_fixes(spark, sf):
    """Every text of the view with broken formulas and diagrams, fixed, with its report."""
    out = X.fixed(broken(spark, sf))
    told = F.transform("report", lambda r: F.concat(r.label, F.lit(" ×"), r.n.cast("string"), F.lit(" @"), F.array_join(r.lines, ",")))
    return out.select("doc_id", "text", F.array_join(told, "; ").alias("report"))


QUERIES = {"word_fixes": word_fixes}

_O = "PARTITION BY doc_id ORDER BY line_no"


def context(source: str, name: str) -> str:
    return f"""{name}m AS (SELECT *, regexp_matches(line, '{MARKERS["ticks_or_tildes"]}') AS marker FROM {source}),
{name}f AS (SELECT *, marker OR sum(marker::INT) OVER ({_O}) % 2 = 1 AS in_fence FROM {name}m),
{name}d AS (SELECT *, CASE WHEN in_fence THEN 0 ELSE {Q.count(f"({Q.without_code('line')})", "[$][$]")} END AS delims FROM {name}f),
{name} AS (SELECT *, NOT in_fence AND NOT (sum(delims) OVER ({_O}) % 2 = 1 AND delims = 0) AS active FROM {name}d)"""


def put_in(source: str, before: str, after: str, label: str, name: str) -> str:
    """Lines before and behind others; line_no is counted anew, came keeps the number of the text as it came."""
    return f"""{name}u AS (SELECT doc_id, came, line_no, unnest([{before}, line, {after}]) AS line, unnest([[], CASE WHEN {before} IS NOT NULL THEN list_append(fixes, '{label}') ELSE fixes END, []]) AS fixes, unnest([0, 1, 2]) AS d FROM {source}),
{name} AS (SELECT doc_id, came, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, d) AS line_no, line, fixes FROM {name}u WHERE line IS NOT NULL)"""


_ROUND, _SQUARE = r"contains(line, '\(') AND contains(line, '\)')", r"contains(x, '\[') AND contains(x, '\]')"
_TRIM = Q.trim("line")
ORACLES = {
    "word_fixes": rf"""WITH {LINES}, l0 AS (SELECT doc_id, line_no, line_no AS came, line, []::VARCHAR[] AS fixes FROM lines),
{context("l0", "a0")},
b0 AS (SELECT *, CASE WHEN NOT in_fence AND {_ROUND} THEN replace(replace(line, '\(', '$'), '\)', '$') ELSE line END AS x FROM a0),
l1 AS (SELECT doc_id, line_no, came, CASE WHEN in_fence THEN line WHEN {_SQUARE} THEN replace(replace(x, '\[', '$$'), '\]', '$$') WHEN {Q.trim("x")} IN ('\[', '\]') THEN '$$' ELSE x END AS line,
    list_filter([CASE WHEN NOT in_fence AND {_ROUND} THEN 'inline delimiters' END, CASE WHEN NOT in_fence AND (({_SQUARE.replace("x", "line")}) OR {_TRIM} IN ('\[', '\]')) THEN 'block delimiters' END], lambda f: f IS NOT NULL) AS fixes FROM b0),
{context("l1", "a1")},
b1 AS (SELECT *, CASE WHEN active THEN regexp_replace(regexp_replace({Q.without_code("line")}, '[$][$][^$]*[$][$]', '', 'g'), '[$][^$\n]+[$]', '', 'g') ELSE '' END AS bare FROM a1),
c1 AS (SELECT *, {Q.trim(_latex("bare"))} AS whole, string_split_regex(line, '{W.RUN}') AS p, list_transform(regexp_extract_all(line, '{W.RUN}'), lambda x: CASE WHEN regexp_matches(x, '{W.LINEAR}') THEN '$' || {Q.trim(_latex("x"))} || '$' ELSE x END) AS q FROM b1),
d1 AS (SELECT *, CASE WHEN NOT regexp_matches(bare, '{W.LINEAR}') THEN line WHEN regexp_matches(line, '[一-鿿]') THEN array_to_string(list_transform(p, lambda x, i: x || coalesce(q[i], '')), '')
    WHEN whole = '' THEN line WHEN starts_with(whole, '$$') THEN whole ELSE '$$' || whole || '$$' END AS new FROM c1),
l2 AS (SELECT doc_id, line_no, came, new AS line, CASE WHEN new <> line THEN list_append(fixes, 'linear formula') ELSE fixes END AS fixes FROM d1),
{context("l2", "a2")},
s2 AS (SELECT doc_id, line_no AS first_line, regexp_extract({_TRIM}, '{W.ENVIRONMENT}', 1) AS name FROM a2 WHERE active AND regexp_matches({_TRIM}, '{W.ENVIRONMENT}')),
e2 AS (SELECT s2.doc_id, first_line, s2.name, min(l.line_no) AS last_line FROM s2 JOIN l2 l ON l.doc_id = s2.doc_id AND l.line_no >= first_line AND contains(l.line, '\end{{' || s2.name || '}}') GROUP BY 1, 2, 3),
k2 AS (SELECT e2.* FROM e2 WHERE NOT (EXISTS (SELECT 1 FROM l2 l WHERE l.doc_id = e2.doc_id AND l.line_no = first_line - 1 AND {Q.trim("l.line")} = '$$') AND EXISTS (SELECT 1 FROM l2 l WHERE l.doc_id = e2.doc_id AND l.line_no = last_line + 1 AND {Q.trim("l.line")} = '$$'))),
v2 AS (SELECT * FROM k2 WHERE NOT EXISTS (SELECT 1 FROM k2 o WHERE o.doc_id = k2.doc_id AND o.first_line < k2.first_line AND o.last_line >= k2.first_line)),
w2 AS (SELECT l2.*, CASE WHEN o.doc_id IS NOT NULL THEN '$$' END AS opens, CASE WHEN z.doc_id IS NOT NULL THEN '$$' END AS closes FROM l2 LEFT JOIN v2 o ON o.doc_id = l2.doc_id AND o.first_line = l2.line_no LEFT JOIN v2 z ON z.doc_id = l2.doc_id AND z.last_line = l2.line_no),
{put_in("w2", "opens", "closes", "bare environment", "l3")},
{context("l3", "a3")},
h3 AS (SELECT *, regexp_matches({_TRIM}, '{W.DIAGRAM}') AS head, regexp_matches(line, '{W.ARROW}') AS arrow, NOT in_fence AND NOT regexp_matches({Q.trim_start("line")}, '{W.NO_DIAGRAM}') AS plain FROM a3),
r3 AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM h3 WHERE plain AND (head OR arrow)),
g3 AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE arrow) OVER w AS arrows, max(line_no) OVER w AS last_line FROM r3 WINDOW w AS (PARTITION BY doc_id, run ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v3 AS (SELECT doc_id, min(line_no) AS first_line, max(last_line) AS last_line FROM g3 WHERE (head AND n >= 2) OR (n >= 3 AND arrows >= 2) GROUP BY doc_id, run),
w3 AS (SELECT l3.*, CASE WHEN o.doc_id IS NOT NULL THEN '```mermaid' END AS opens, CASE WHEN z.doc_id IS NOT NULL THEN '```' END AS closes FROM l3 LEFT JOIN v3 o ON o.doc_id = l3.doc_id AND o.first_line = l3.line_no LEFT JOIN v3 z ON z.doc_id = l3.doc_id AND z.last_line = l3.line_no),
{put_in("w3", "opens", "closes", "diagram", "l4")},
{context("l4", "a4")},
l5 AS (SELECT doc_id, line_no, came, CASE WHEN in_fence THEN line ELSE {Q.clean("line")} END AS line, list_concat(fixes, list_filter([CASE WHEN NOT in_fence AND regexp_matches(line, '[{INVISIBLE}]') THEN 'invisible characters' END,
    CASE WHEN NOT in_fence AND contains(line, '{NBSP}') THEN 'no-break spaces' END, CASE WHEN NOT in_fence AND regexp_matches(line, '[{WIDE}]') THEN 'wide letters' END], lambda f: f IS NOT NULL)) AS fixes FROM a4),
n AS (SELECT doc_id, label, count(*) AS n, list(came ORDER BY came)[:3] AS came FROM (SELECT doc_id, came, unnest(fixes) AS label FROM l5) GROUP BY 1, 2),
t AS (SELECT doc_id, string_agg(label || ' ×' || n || ' @' || array_to_string(came, ','), '; ' ORDER BY label) AS report FROM n GROUP BY 1)
SELECT l5.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, coalesce(any_value(report), '') AS report FROM l5 LEFT JOIN t USING (doc_id) GROUP BY 1""",
}
