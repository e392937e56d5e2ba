"""Queries of page breaks and nested lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators import nesting as N
from ..operators import pagination as G
from ..operators.lines import island, lines
from ..sources.messy import messy, quote
from ..sources.tables import read
from . import sqltext as Q

#: Rows of a page and characters of a row.
HEIGHT, WIDTH = 24, 60
KINDS = [("break", "^<!-- pagebreak -->"), ("heading", "^#{1,6} "), ("table", "^[|]"), ("caption", r"^[*_](图|表|Table|Figure)"), ("figure", r"!\[")]


def page_blocks(spark, sf):
    """The messy texts' lines as blocks: runs of pipe rows are tables, the first row their header; long lines take several rows."""
    rows = lines(messy(spark, sf)).withColumn("t", trim(F.col("line")))
    kind = F
    for name, pattern in KINDS:
        kind = kind.when(F.col("t").rlike(pattern), name)
    rows = rows.withColumn("kind", kind.otherwise("text")).withColumn("row", F.col("kind") == "table")
    rows = rows.withColumn("run", F.when(F.col("row"), island(F.col("row"))).otherwise(-F.col("line_no"))).where("t <> ''")
    rows = rows.groupBy("doc_id", "run", "kind").agg(F.min("line_no").alias("ord"), F.count("*").cast("int").alias("m"), F.max(F.ceil(F.length("t") / WIDTH)).cast("int").alias("k"))
    header = F.when((F.col("kind") == "table") & (F.col("m") > 1), 1).otherwise(0)
    sizes = F.when(F.col("kind") == "table", F.array_repeat(F.lit(1), F.col("m") - header)).when(F.col("kind") == "text", F.array_repeat(F.lit(1), F.col("k"))).when(F.col("kind") == "figure", F.array(F.lit(7))).otherwise(F.array(F.lit(2)))
    return rows.select("doc_id", "ord", "kind", F.when(F.col("ord") % 7 == 0, 2).otherwise(1).alias("gap"), sizes.alias("sizes"), header.alias("header"))


def page_breaks(spark, sf):
    return G.pages(page_blocks(spark, sf), HEIGHT)


#: Lists before each text, by the document's number.
LISTS = ["1. a\n   - b\n   - c\n      1. d\n\n      2. e\n2. f\n\t* [ ] g\n\n", "- a\n  - b\n    - c\n      - d\n        - e\n          - f\n   1. g\n- [x] h\n1. i\n", "+ a\n text\n+ b\nend\n+ c\n```\n- d\n```\n"]


def nested_lists(spark, sf):
    """Lists of the documents; each sentence of a text is a list line, indented by its length."""
    head = F.get(F.array(*map(F.lit, LISTS)), (F.col("doc_id") % len(LISTS)).cast("int"))
    sentence = F.transform(F.split("text", "[.][ \n]"), lambda x, i: F.concat(F.repeat(F.lit(" "), F.length(x) % 9), F.when(i % 3 == 0, "1. ").otherwise("- "), x))
    return N.nested_lists(read(spark, sf, "documents").select("doc_id", F.concat(head, F.array_join(sentence, "\n")).alias("text")))


QUERIES = {f.__name__: f for f in (page_breaks, nested_lists)}

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in KINDS) + " ELSE 'text' END"
#: A document's pieces one after the other, with the page, how much of it is used and what it started with.
ORACLES = {
    "page_breaks": f"""WITH RECURSIVE {Q.BASE.removeprefix("WITH ")}, a AS (SELECT *, {Q.trim("line")} AS t FROM lines), b AS (SELECT *, {_KIND} AS kind FROM a),
c AS (SELECT *, CASE WHEN kind = 'table' THEN sum((kind <> 'table')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) ELSE -line_no END AS run FROM b),
d AS (SELECT doc_id, kind, min(line_no) AS ord, count(*) AS m, max(ceil(length(t) / {WIDTH}.0))::INT AS k FROM c WHERE t <> '' GROUP BY doc_id, run, kind),
e AS (SELECT doc_id, ord, kind, CASE WHEN ord % 7 = 0 THEN 2 ELSE 1 END AS gap, CASE WHEN kind = 'table' AND m > 1 THEN 1 ELSE 0 END AS header, m, k FROM d),
f AS (SELECT *, CASE kind WHEN 'table' THEN m WHEN 'text' THEN k ELSE 1 END AS n, CASE kind WHEN 'figure' THEN 7 WHEN 'text' THEN 1 WHEN 'table' THEN 1 WHEN 'break' THEN 0 ELSE 2 END AS h FROM e),
g AS (SELECT *, CASE WHEN kind IN ('text', 'table') THEN least(n, 2) ELSE h END AS beginning FROM f),
i AS (SELECT *, lead(beginning, 1, 0) OVER o AS nb, lead(kind) OVER o AS nk, lag(kind) OVER o AS pk FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
j AS (SELECT *, unnest(range(n)) AS idx FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, idx) AS u, idx > 0 OR coalesce(pk <> 'break', false) AS moved,
    CASE WHEN idx > 0 OR kind = 'break' OR pk = 'break' OR (pk = 'figure' AND kind = 'caption') THEN 0 ELSE gap END AS space,
    CASE WHEN kind = 'text' AND idx = 0 THEN least(n, CASE WHEN n = 3 THEN 3 ELSE 2 END) WHEN kind = 'text' AND idx = n - 2 THEN 2 WHEN kind = 'heading' OR (kind = 'figure' AND nk = 'caption') THEN h + nb
      WHEN kind = 'break' OR (kind = 'table' AND header = 1 AND idx = 0) THEN 0 ELSE h END AS need FROM j),
r(doc_id, u, ord, idx, kind, page, used, full_, cut) AS (
    SELECT doc_id, u, ord, idx, kind, 1, h, kind = 'break', NULL::BIGINT FROM p WHERE u = 1
    UNION ALL SELECT doc_id, u, ord, idx, kind, CASE WHEN fits THEN page ELSE page + 1 END, CASE WHEN fits THEN start + h ELSE CASE WHEN kind = 'table' AND idx > 0 THEN header ELSE 0 END + h END, kind = 'break',
        CASE WHEN fits THEN cut WHEN moved THEN ord END FROM (
      SELECT p.*, r.page, r.cut, start, NOT full_ AND (start = 0 OR start + CASE WHEN p.kind = 'text' AND p.ord = r.cut THEN p.h ELSE p.need END <= {HEIGHT}) AS fits
      FROM (SELECT r.*, x.space, used + CASE WHEN used > 0 AND used + x.space <= {HEIGHT} THEN x.space ELSE 0 END AS start FROM r JOIN p x ON x.doc_id = r.doc_id AND x.u = r.u + 1) r
      JOIN p ON p.doc_id = r.doc_id AND p.u = r.u + 1)),
l AS (SELECT doc_id, min(u) FILTER (WHERE kind <> 'break') - 1 AS lead_ FROM p GROUP BY 1)
SELECT doc_id, (page - lead_)::BIGINT AS page, arg_min(ord, u) AS first_block, arg_min(idx, u)::BIGINT AS first_part, arg_max(ord, u) AS last_block, arg_max(idx, u)::BIGINT AS last_part, count(*) AS n_parts
FROM r JOIN l USING (doc_id) WHERE kind <> 'break' GROUP BY doc_id, page, lead_""",
    # the path to each item as a list, item by item
    "nested_lists": f"""WITH RECURSIVE d AS (SELECT doc_id, string_split([{", ".join(quote(x) for x in LISTS)}][doc_id % {len(LISTS)} + 1] || array_to_string(list_transform(regexp_split_to_array(text, '[.][ \\n]'),
        lambda x, i: repeat(' ', length(x) % 9) || CASE WHEN (i - 1) % 3 = 0 THEN '1. ' ELSE '- ' END || x), chr(10)), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM d), {Q.fenced("ticks")},
a AS (SELECT *, NOT in_fence AND regexp_matches(line, {quote(N.ITEM)}) AS item FROM f),
b AS (SELECT *, sum((NOT item AND {Q.trim("line")} <> '' AND NOT regexp_matches(line, '^[ \\t]'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run, regexp_extract(line, {quote(N.ITEM)}, ['s', 'm', 't']) AS x FROM a),
c AS (SELECT doc_id, run, line_no, length(replace(x.s, chr(9), '    ')) AS indent, CASE WHEN x.t <> '' THEN 'task' WHEN regexp_matches(x.m, '^[0-9]') THEN 'ordered' ELSE 'bullet' END AS kind,
    row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) AS k FROM b WHERE item),
r(doc_id, run, k, path, line_no, depth, kind, number, parent) AS (
    SELECT doc_id, run, 0::BIGINT, []::STRUCT(indent BIGINT, ordered BOOLEAN, number INTEGER, line_no BIGINT)[], 0::BIGINT, 0::BIGINT, '', 0, 0::BIGINT FROM c WHERE k = 1
    UNION ALL SELECT doc_id, run, k, list_append(above, {{'indent': indent, 'ordered': kind = 'ordered', 'number': number, 'line_no': line_no}}), line_no, len(above), kind, number, above[len(above)].line_no FROM (
        SELECT *, CASE WHEN path[len(above) + 1].ordered = (kind = 'ordered') THEN path[len(above) + 1].number + 1 ELSE 1 END AS number FROM (
            SELECT c.*, r.path, list_filter(r.path, lambda s: s.indent < c.indent) AS above FROM r JOIN c ON c.doc_id = r.doc_id AND c.run = r.run AND c.k = r.k + 1)))
SELECT doc_id, line_no, depth, least(depth, 4) AS level, kind, number, CASE kind WHEN 'ordered' THEN number || '.' WHEN 'bullet' THEN '•' ELSE '' END AS marker, parent FROM r WHERE k > 0""",
}
