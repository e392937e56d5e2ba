"""Queries over documents: repair, validation and statistics, with their SQL. All run over the messy view of the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import lines as L
from ..operators import repair as R
from ..sources.messy import MESSY_SQL, NL, messy
from . import sqltext as Q

RULES = R.RULES


def fence_context(spark, sf):
    rows = R.repair_inline(messy(spark, sf))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("marker").alias("markers"), F.count_if("in_fence").alias("fenced"), F.sum("delims").cast("bigint").alias("delims"))


def repair_fix_counts(spark, sf):
    return R.fix_report(R.repair_inline(messy(spark, sf)), RULES)


def repair_lines(spark, sf):
    return R.repair_inline(messy(spark, sf)).where("fixed <> line").select("doc_id", "line_no", "fixed")


def repair_table_rows(spark, sf):
    return R.repaired_rows(messy(spark, sf)).select("doc_id", "line_no", "table_fixed", "last_pipe", "missing_cells")


def repair_text(spark, sf):
    return R.repair(messy(spark, sf)).withColumn("text", F.md5("text"))


def validate_warnings(spark, sf):
    return D.validate(messy(spark, sf))


def doc_stats(spark, sf):
    return D.stats(messy(spark, sf))


def live_stats(spark, sf):
    return D.live_stats(messy(spark, sf))


def health_counts(spark, sf):
    return D.feature_counts(messy(spark, sf))


def heading_jumps(spark, sf):
    return D.heading_jumps(messy(spark, sf))


def encoding_quality(spark, sf):
    return D.quality(messy(spark, sf))


def mojibake_flags(spark, sf):
    return D.mojibake(messy(spark, sf))


def source_warnings(spark, sf):
    return D.source_warnings(messy(spark, sf))


def issue_summary(spark, sf):
    """Per document: errors, warnings and the warning rules in order of first sight."""
    w = D.validate(messy(spark, sf))
    first = w.groupBy("doc_id", "rule", "level").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    warn = F.array_sort(F.collect_list(F.when(F.col("level") == "warn", F.struct("first", "rule"))))
    return first.groupBy("doc_id").agg(F.sum(F.when(F.col("level") == "error", F.col("n")).otherwise(0)).alias("errors"), F.sum(F.when(F.col("level") == "warn", F.col("n")).otherwise(0)).alias("warnings"), F.array_join(F.transform(warn, lambda s: s.rule), ",").alias("rules"))


def pagebreak_count(spark, sf):
    return messy(spark, sf).select("doc_id", F.regexp_count("text", F.lit(D.PAGEBREAK)).alias("comments"), F.regexp_count("text", F.lit(D.PAGE_MARK)).alias("marks"))


def captions(spark, sf):
    return D.captions(messy(spark, sf))


def unescape_bold(spark, sf):
    new = F.regexp_replace("text", D.ESCAPED_BOLD, "**$1**")
    return messy(spark, sf).select("doc_id", F.md5(new).alias("text")).join(messy(spark, sf).where(F.col("text").rlike(D.ESCAPED_BOLD)).select("doc_id"), "doc_id", "left_semi")


def structure_clean(spark, sf):
    rows = L.with_fences(L.lines(messy(spark, sf)), "ticks_or_tildes").where("NOT in_fence")
    return rows.withColumn("cleaned", X.clean(F.col("line"))).where("cleaned <> line").select("doc_id", "line_no", "cleaned")


def delimiter_convert(spark, sf):
    rows = L.with_fences(L.lines(messy(spark, sf)), "ticks_or_tildes").where("NOT in_fence")
    return rows.withColumn("converted", D.convert_delimiters(F.col("line"))).where("converted <> line").select("doc_id", "line_no", "converted")


def formula_readiness(spark, sf):
    """Lines outside fences that hold linear-formula triggers, per document."""
    rows = L.with_fences(L.lines(messy(spark, sf)), "ticks_or_tildes")
    return rows.groupBy("doc_id").agg(F.count_if(~F.col("in_fence") & F.col("line").rlike(D.LINEAR)).alias("linear"), F.count_if(~F.col("in_fence") & F.col("line").rlike(D.INLINE_MATH)).alias("inline"))


QUERIES = {f.__name__: f for f in (
    fence_context, repair_fix_counts, repair_lines, repair_table_rows, repair_text, validate_warnings, doc_stats, live_stats, health_counts, heading_jumps, encoding_quality, mojibake_flags, source_warnings, issue_summary,
    pagebreak_count, captions, unescape_bold, structure_clean, delimiter_convert, formula_readiness,
)}

_OVER = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
INLINE = f"""{Q.BASE}, {Q.fenced("ticks_or_tildes")},
d AS (SELECT *, CASE WHEN in_fence THEN 0 ELSE {Q.count(f"({Q.without_code('line')})", "[$][$]")} END AS delims FROM f),
a AS (SELECT *, NOT in_fence AND NOT (sum(delims) {_OVER} % 2 = 1 AND delims = 0) AS active FROM d),
s1 AS (SELECT *, active AND regexp_matches(line, '{R.HEADING}') AS heading_space FROM a),
s2 AS (SELECT *, CASE WHEN heading_space THEN regexp_replace(line, '{R.HEADING}', '\\1 \\2') ELSE line END AS x1 FROM s1),
s3 AS (SELECT *, active AND {Q.count("x1", "`")} % 2 = 1 AS inline_code FROM s2),
s4 AS (SELECT *, CASE WHEN inline_code THEN x1 || '`' ELSE x1 END AS x2 FROM s3),
s5 AS (SELECT *, active AND {Q.count(f"({Q.without_code('x2')})", "[*][*]")} % 2 = 1 AS bold FROM s4),
s6 AS (SELECT *, CASE WHEN bold THEN x2 || '**' ELSE x2 END AS x3 FROM s5),
s7 AS (SELECT *, regexp_replace({Q.without_code("x3")}, '[$][$][^$]*[$][$]', '', 'g') AS mathish FROM s6),
s8 AS (SELECT *, active AND ({Q.count("mathish", "[$]")} - {Q.count("mathish", chr(92) * 2 + "[$]")}) % 2 = 1 AND regexp_matches(mathish, '{R.MATH_SIGNAL}') AS math FROM s7),
r AS (SELECT *, CASE WHEN math THEN x3 || '$' ELSE x3 END AS fixed FROM s8)"""


def _cells(x: str) -> str:
    return f"({Q.count(Q.trim(x), '[|]')} - CASE WHEN ends_with({Q.trim(x)}, '|') THEN 1 ELSE 0 END)"


_T = Q.trim("fixed")
TABLES = f"""{INLINE},
t1 AS (SELECT *, starts_with({_T}, '|') AND length({_T}) >= 3 AND regexp_matches({_T}, '{R.SEPARATOR}') AS sep, starts_with({_T}, '|') AND length({_T}) >= 2 AND NOT regexp_matches({_T}, '{R.SEPARATOR}') AS content FROM r),
t2 AS (SELECT *, CASE WHEN sep OR content THEN sum((NOT (sep OR content))::INT) {_OVER} END AS run FROM t1),
t3 AS (SELECT *, min(CASE WHEN sep THEN line_no END) OVER g AS first_sep, sum(content::INT) OVER g AS n_content FROM t2 WINDOW g AS (PARTITION BY doc_id, run)),
t4 AS (SELECT *, coalesce(max(CASE WHEN content AND line_no < first_sep THEN line_no END) OVER g, min(CASE WHEN content THEN line_no END) OVER g) AS header FROM t3 WINDOW g AS (PARTITION BY doc_id, run)),
t5 AS (SELECT *, max(CASE WHEN line_no = header THEN {_cells("fixed")} END) OVER (PARTITION BY doc_id, run) AS width, {Q.trim_end("fixed")} AS cut FROM t4),
t6 AS (SELECT *, run IS NOT NULL AND content AND CASE WHEN first_sep IS NOT NULL THEN n_content >= 1 ELSE n_content >= 2 END AS acts FROM t5),
t7 AS (SELECT *, acts AND NOT ends_with(cut, '|') AS last_pipe FROM t6),
t8 AS (SELECT *, CASE WHEN last_pipe THEN cut || ' |' ELSE cut END AS closed FROM t7),
t9 AS (SELECT *, width - {_cells("closed")} AS short FROM t8),
t AS (SELECT *, acts AND short > 0 AS missing_cells, CASE WHEN acts AND short > 0 THEN closed || repeat(' |', short) WHEN last_pipe THEN closed ELSE fixed END AS table_fixed FROM t9)"""

VALIDATE = f"""{Q.BASE}, {Q.fenced("ticks")},
w AS (
  SELECT doc_id, max(line_no) AS line, 'open_fence' AS rule, 'error' AS level FROM lines WHERE starts_with(line, '```') GROUP BY 1 HAVING count(*) % 2 = 1
  UNION ALL SELECT doc_id, max(line_no), 'open_math', 'error' FROM (SELECT *, {Q.count("line", "[$][$]")} AS n FROM f WHERE NOT in_fence) WHERE n > 0 GROUP BY 1 HAVING sum(n) % 2 = 1
  UNION ALL SELECT doc_id, line_no, 'empty_heading', 'warn' FROM lines WHERE regexp_matches(line, '{D.EMPTY_HEADING}')
  UNION ALL SELECT doc_id, line_no, 'inline_code', 'warn' FROM f WHERE NOT in_fence AND {Q.count("line", "`")} % 2 = 1)"""

ORACLES = {
    "fence_context": f"WITH {INLINE} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE marker) AS markers, count(*) FILTER (WHERE in_fence) AS fenced, sum(delims)::BIGINT AS delims FROM r GROUP BY 1",
    "repair_fix_counts": f"""WITH {INLINE}, x AS ({" UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS rule FROM r WHERE {k}" for k in RULES)}),
      y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY line_no) AS rn FROM x) SELECT doc_id, rule, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) FILTER (WHERE rn <= 3) AS examples FROM y GROUP BY 1, 2""",
    "repair_lines": f"WITH {INLINE} SELECT doc_id, line_no, fixed FROM r WHERE fixed <> line",
    "repair_table_rows": f"WITH {TABLES} SELECT doc_id, line_no, table_fixed, last_pipe, missing_cells FROM t WHERE last_pipe OR missing_cells",
    "repair_text": f"""WITH {TABLES}, g AS (SELECT doc_id, string_agg(table_fixed, '{NL}' ORDER BY line_no) AS text, {", ".join(f"count(*) FILTER (WHERE {k}) AS {k}" for k in [*RULES, "last_pipe", "missing_cells"])}, sum(delims) % 2 = 1 AS open_math, count(*) FILTER (WHERE marker) % 2 = 1 AS open_fence FROM t GROUP BY 1)
      SELECT * REPLACE (md5(text || CASE WHEN open_math THEN '{NL}$$' ELSE '' END || CASE WHEN open_fence THEN '{NL}```' ELSE '' END) AS text) FROM g""",
    "validate_warnings": f"WITH {VALIDATE} SELECT * FROM w",
    "issue_summary": f"""WITH {VALIDATE}, g AS (SELECT doc_id, rule, level, count(*) AS n, min(line) AS first FROM w GROUP BY 1, 2, 3)
      SELECT doc_id, sum(CASE WHEN level = 'error' THEN n ELSE 0 END)::BIGINT AS errors, sum(CASE WHEN level = 'warn' THEN n ELSE 0 END)::BIGINT AS warnings, coalesce(string_agg(rule, ',' ORDER BY first, rule) FILTER (WHERE level = 'warn'), '') AS rules FROM g GROUP BY 1""",
    "doc_stats": f"""WITH {MESSY_SQL} SELECT doc_id, {Q.count("text", D.STAT_HEADING)} AS headings, {Q.count("text", D.STAT_ROW)} - {Q.count("text", D.STAT_SEPARATOR)} AS table_rows, {Q.count("text", D.IMAGE)} AS images, {Q.count("text", D.STAT_FENCE)} // 2 AS code_blocks, {Q.count("text", D.PAGEBREAK)} AS pagebreaks, length(text) AS chars FROM messy""",
    "live_stats": f"""WITH {MESSY_SQL}, c AS (SELECT *, length(regexp_replace(text, '[{X.WS}]', '', 'g')) AS chars, regexp_replace(text, '(?s)[$][$].+?[$][$]', '', 'g') AS rest FROM messy)
      SELECT doc_id, chars, {Q.count("text", "(?s)[$][$].+?[$][$]")} + {Q.count("rest", D.LIVE_MATH)} AS math, len(list_filter(string_split(text, '{NL}'), lambda x: contains(x, '|') AND contains(x, '-') AND regexp_matches({Q.trim("x")}, '^[{X.WS}|:+-]+$'))) AS tables, {Q.count("text", D.IMAGE)} AS images,
        CASE WHEN chars > 0 THEN greatest(1, ceil(chars / 900.0))::BIGINT END AS pages FROM c""",
    "health_counts": f"""WITH {MESSY_SQL} SELECT doc_id, {Q.count("text", D.HEALTH_MATH)} AS math, CASE WHEN {Q.count("text", D.STAT_ROW)} >= 2 THEN 1 ELSE 0 END AS tables, {Q.count("text", D.STAT_FENCE)} // 2 AS code_blocks, {Q.count("text", D.IMAGE)} AS images FROM messy""",
    "heading_jumps": f"""WITH {Q.BASE}, {Q.fenced("ticks")}, h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#+)', 1)) AS level FROM f WHERE NOT in_fence AND regexp_matches(line, '{D.HEADING_LINE}')),
      j AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM h) SELECT doc_id, line_no, before, level FROM j WHERE level > before + 1""",
    "encoding_quality": f"""WITH {MESSY_SQL} SELECT doc_id, {Q.count("text", D.SOUND)} AS valid, length(text) + {Q.count("text", D.ASTRAL)} AS units, round({Q.count("text", D.SOUND)} / nullif(length(text) + {Q.count("text", D.ASTRAL)}, 0)::DOUBLE, 6) AS quality FROM messy""",
    "mojibake_flags": f"""WITH {MESSY_SQL}, c AS (SELECT *, {Q.count("text", D.REPLACED)} AS replaced, {Q.count("text", D.LATIN_CJK)} AS latin FROM messy)
      SELECT doc_id, replaced, latin, CASE WHEN replaced > 3 THEN len(string_split(text[:strpos(text, '{D.REPLACED}') - 1], '{NL}')) END AS replaced_line, latin > 5 AS is_latin FROM c WHERE replaced > 3 OR latin > 5""",
    "source_warnings": f"""WITH {MESSY_SQL}, c AS (SELECT doc_id, regexp_matches(text, '{D.PDF_MARK}') AS pdf_marks, regexp_matches(text, '{D.ESCAPED_BOLD}') AS escaped_bold, regexp_matches(text, '{D.ESCAPED_TABLE}') AS escaped_table FROM messy) SELECT * FROM c WHERE pdf_marks OR escaped_bold OR escaped_table""",
    "pagebreak_count": f"WITH {MESSY_SQL} SELECT doc_id, {Q.count('text', D.PAGEBREAK)} AS comments, {' + '.join(Q.count('text', p) for p in D.PAGE_MARKS)} AS marks FROM messy",
    "captions": f"""WITH {Q.BASE}, c AS (SELECT doc_id, line_no, line, CASE {" ".join(f"WHEN regexp_matches(line, '{p}') THEN {i}" for i, p in enumerate(D.CAPTION_BOTH))} END AS p FROM lines),
      k AS (SELECT doc_id, line_no, CASE p {" ".join(f"WHEN {i} THEN regexp_extract(line, '{p}', 1)" for i, p in enumerate(D.CAPTION_BOTH))} END AS word, CASE p {" ".join(f"WHEN {i} THEN regexp_extract(line, '{p}', 2)" for i, p in enumerate(D.CAPTION_BOTH))} END AS text FROM c WHERE p IS NOT NULL),
      n AS (SELECT *, CASE WHEN regexp_matches(word, '(?i)^(图|fig)') THEN 'fig' ELSE 'tbl' END AS kind FROM k) SELECT doc_id, line_no, kind, {Q.trim("text")} AS text, row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) AS number FROM n""",
    "unescape_bold": f"WITH {MESSY_SQL} SELECT doc_id, md5(regexp_replace(text, '{D.ESCAPED_BOLD}', '**\\1**', 'g')) AS text FROM messy WHERE regexp_matches(text, '{D.ESCAPED_BOLD}')",
    "structure_clean": f"WITH {Q.BASE}, {Q.fenced('ticks_or_tildes')}, c AS (SELECT doc_id, line_no, line, {Q.clean('line')} AS cleaned FROM f WHERE NOT in_fence) SELECT doc_id, line_no, cleaned FROM c WHERE cleaned <> line",
    "delimiter_convert": f"""WITH {Q.BASE}, {Q.fenced("ticks_or_tildes")},
      p AS (SELECT doc_id, line_no, line, CASE WHEN contains(line, '\\(') AND contains(line, '\\)') THEN replace(replace(line, '\\(', '$'), '\\)', '$') ELSE line END AS x FROM f WHERE NOT in_fence),
      q AS (SELECT *, CASE WHEN contains(x, '\\[') AND contains(x, '\\]') THEN replace(replace(x, '\\[', '$$'), '\\]', '$$') WHEN {Q.trim("x")} IN ('\\[', '\\]') THEN '$$' ELSE x END AS converted FROM p)
      SELECT doc_id, line_no, converted FROM q WHERE converted <> line""",
    "formula_readiness": f"""WITH {Q.BASE}, {Q.fenced("ticks_or_tildes")} SELECT doc_id, count(*) FILTER (WHERE NOT in_fence AND regexp_matches(line, '{D.LINEAR}')) AS linear, count(*) FILTER (WHERE NOT in_fence AND regexp_matches(line, '{D.INLINE_MATH}')) AS inline FROM f GROUP BY 1""",
}
