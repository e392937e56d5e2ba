"""Queries of structure inference over the messy view, and their SQL."""

from __future__ import annotations

from ..functions.text import CJK, INVISIBLE, NARROW, WIDE, WS
from ..operators import structure as T
from ..sources.messy import messy
from . import sqltext as Q

_NAMES = "page_number_noise repeated_headers paragraph_rejoin blank_collapse heading_prefixes keyword_headings caps_headings table_inference separator_injection bullets callouts typography".split()
QUERIES = {name: (lambda f: lambda spark, sf: f(messy(spark, sf)))(getattr(T, name)) for name in _NAMES}

HEAD = f"{Q.BASE}, {Q.fenced('ticks')}"
OUT = f"{HEAD}, o AS (SELECT doc_id, line_no, line FROM f WHERE NOT in_fence)"
_ROWS = "PARTITION BY doc_id ORDER BY line_no"
_NOISE = f"(regexp_matches(line, '{T.PAGE_NUMBER}') OR regexp_matches(line, '{T.PAGE_NUMBER_CJK}'))"
_PLAIN = " AND ".join(f"NOT regexp_matches(line, '{p}')" for p in (T.TABLE_ROW, T.SEPARATOR_ROW, T.ORDERED, T.UNORDERED))
_COLS = f"list_filter(list_transform(regexp_split_to_array({Q.trim('line')}, '\\t|[ \\t]{{2,}}'), lambda x: {Q.trim('x')}), lambda x: x <> '')"


def _polish(x: str) -> str:
    x = f"replace(translate(regexp_replace({x}, '[{INVISIBLE}]', '', 'g'), '{WIDE}', '{NARROW}'), '　', ' ')"
    steps = [(f"([{CJK}])([a-zA-Z0-9])", r"\1 \2"), (f"([a-zA-Z0-9])([{CJK}])", r"\1 \2"), (rf"([{CJK}])[ \t]+([，。！？；：、）】》」』\]])", r"\1\2"), (rf"([（【《「『])[ \t]+([{CJK}])", r"\1\2")]
    # no look-ahead here: a second pass takes the places whose first character the first pass has used, a third those at the end
    for n, w, behind in T.PUNCTUATION:
        steps += [(rf"([{CJK}])[ \t]*[{n}]{behind}([{CJK}])", rf"\1{w}\2")] * 2 + [(rf"([{CJK}])[ \t]*[{n}]{behind}$", rf"\1{w}")]
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


CAPS = T.CAPS.replace("'", "''")
ORACLES = {
    "page_number_noise": f"WITH {OUT} SELECT doc_id, line_no, line FROM o WHERE {_NOISE}",
    "repeated_headers": f"""WITH {HEAD}, a AS (SELECT *, {Q.trim("line")} AS t FROM f WHERE in_fence OR NOT {_NOISE}),
      b AS (SELECT *, NOT in_fence AND length(t) BETWEEN 2 AND 60 AND regexp_matches(t, '{T.LETTER}') AS c FROM a), d AS (SELECT *, sum(c::INT) OVER (PARTITION BY doc_id, t) AS times FROM b),
      e AS (SELECT *, c AND times >= 3 AND NOT regexp_matches(t, '{T.STARTER}') AS drop_it FROM d),
      g AS (SELECT doc_id FROM e GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT CASE WHEN t <> '' THEN t END) >= 10 AND count(*) FILTER (WHERE drop_it) > 0 AND count(*) FILTER (WHERE drop_it) < count(*) FILTER (WHERE t <> '') AND 100 * count(*) FILTER (WHERE drop_it) <= 15 * count(*) FILTER (WHERE t <> ''))
      SELECT doc_id, line_no, t FROM e WHERE drop_it AND doc_id IN (SELECT doc_id FROM g)""",
    "paragraph_rejoin": rf"""WITH {HEAD}, a AS (SELECT *, CASE WHEN in_fence THEN line ELSE {Q.trim("line")} END AS t FROM f),
      b AS (SELECT *, in_fence OR t = '' OR regexp_matches(t, '^[#>*|+=—―\[(（$\\<{{}}-]') OR regexp_matches(t, '^[0-9]{{1,3}}[.、)）]') AS fx FROM a),
      c AS (SELECT *, lag(t) OVER ({_ROWS}) AS p, coalesce(lag(fx) OVER ({_ROWS}), true) AS pfx FROM b),
      d AS (SELECT *, fx OR pfx OR regexp_matches(p, '[。！？：；.!?:…]$') AS s FROM c),
      e AS (SELECT *, CASE WHEN s THEN '' WHEN regexp_matches(p, '[a-zA-Z]{{3}}-$') AND regexp_matches(t, '^[a-z]') THEN '-' WHEN regexp_matches(p, '[a-zA-Z]-$') AND regexp_matches(t, '^[a-z]') THEN '' WHEN regexp_matches(p, '[{CJK}，。、；：！？…）】》」』\]]$') OR regexp_matches(t, '^[{CJK}]') THEN '' ELSE ' ' END AS glue FROM d),
      g AS (SELECT *, coalesce(lead(glue) OVER ({_ROWS}), '') AS ng, sum(s::INT) OVER ({_ROWS} ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM e),
      h AS (SELECT doc_id, part, line_no, CASE WHEN glue = ' ' THEN ' ' ELSE '' END || CASE WHEN ng = '-' THEN regexp_replace(t, '-$', '') ELSE t END AS piece FROM g)
      SELECT doc_id, part, count(*) AS n, string_agg(piece, '' ORDER BY line_no) AS text FROM h GROUP BY 1, 2 HAVING count(*) > 1""",
    "blank_collapse": f"""WITH {HEAD}, a AS (SELECT *, NOT in_fence AND {Q.trim("line")} = '' AS gap FROM f), b AS (SELECT *, lag(gap) OVER ({_ROWS}) AS p FROM a) SELECT doc_id, line_no FROM b WHERE gap AND p""",
    "heading_prefixes": f"""WITH {OUT}, a AS (SELECT *, {Q.trim_start("line")} AS t FROM o), b AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(t, '{p}') THEN {i}" for i, (p, _, _) in enumerate(T.PREFIXES))} END AS k FROM a)
      SELECT doc_id, line_no, CASE k {" ".join(f"WHEN {i} THEN {n}" for i, (_, n, _) in enumerate(T.PREFIXES))} END AS level, CASE k {" ".join(f"WHEN {i} THEN '{t}'" for i, (_, _, t) in enumerate(T.PREFIXES))} END AS type FROM b WHERE k IS NOT NULL""",
    "keyword_headings": f"""WITH {OUT}, a AS (SELECT *, regexp_replace(regexp_replace(line, '[:：][{WS}]*$', ''), '[{WS}]+', '', 'g') AS bare FROM o),
      b AS (SELECT *, CASE WHEN lower(bare) IN ({", ".join(f"'{k}'" for k in T.KEYWORDS)}) THEN bare WHEN regexp_matches(bare, '{T.APPENDIX}') THEN regexp_replace(bare, '{T.APPENDIX}', '\\1 \\2') END AS name FROM a) SELECT doc_id, line_no, '## ' || name AS heading FROM b WHERE name IS NOT NULL""",
    "caps_headings": f"WITH {OUT}, a AS (SELECT *, {Q.trim('line')} AS t FROM o) SELECT doc_id, line_no, '### ' || t AS heading FROM a WHERE regexp_matches(t, '{CAPS}') AND (length(t) >= 6 OR contains(t, ' ')) AND regexp_matches(t, '^.[^\\n]*[A-Z]')",
    "table_inference": f"""WITH {HEAD}, a AS (SELECT *, {_COLS} AS cols FROM f), b AS (SELECT *, NOT in_fence AND {_PLAIN} AND NOT regexp_matches({Q.trim_start("line")}, '^(#|```|> |[0-9]+[.])') AND len(cols) > 1 AS r FROM a),
      c AS (SELECT *, sum((NOT r)::INT) OVER ({_ROWS} ROWS UNBOUNDED PRECEDING) AS run FROM b), d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, min(line_no) OVER (PARTITION BY doc_id, run) AS first FROM c WHERE r)
      SELECT doc_id, line_no, '| ' || array_to_string(cols, ' | ') || ' |' AS text, CASE WHEN line_no = first THEN '|' || repeat('---|', len(cols)) END AS separator FROM d WHERE n > 1""",
    "separator_injection": f"""WITH {HEAD}, a AS (SELECT *, NOT in_fence AND regexp_matches(line, '{T.TABLE_ROW}') AS r FROM f), c AS (SELECT *, sum((NOT r)::INT) OVER ({_ROWS} ROWS UNBOUNDED PRECEDING) AS run FROM a),
      d AS (SELECT doc_id, run, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM c WHERE r GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (WHERE regexp_matches(line, '{T.SEPARATOR_ROW}')) = 0),
      e AS (SELECT *, regexp_replace(regexp_replace({Q.trim("line")}, '^[|]', ''), '[|]$', '') AS i FROM d) SELECT doc_id, line_no, '|' || repeat('---|', {Q.count("i", "[|]")} + 1) AS separator FROM e""",
    "bullets": f"""WITH {OUT}, a AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '{T.BOX_DONE}') THEN regexp_replace(line, '{T.BOX_DONE}', '\\1- [x] ') WHEN regexp_matches(line, '{T.BOX_OPEN}') THEN regexp_replace(line, '{T.BOX_OPEN}', '\\1- [ ] ')
      WHEN regexp_matches(line, '{T.BULLET}') THEN regexp_replace(line, '{T.BULLET}', '\\1- ') END AS text FROM o) SELECT * FROM a WHERE text IS NOT NULL""",
    "callouts": f"""WITH {OUT}, b AS (SELECT *, {Q.trim_start("line")} AS t FROM o), a AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(t, '{T.QUOTE}') THEN regexp_replace(t, '{T.QUOTE}', '> **\\1**：') WHEN regexp_matches(t, '{T.REFERENCE}') THEN regexp_replace(t, '{T.REFERENCE}', '**\\1** ') END AS text FROM b) SELECT * FROM a WHERE text IS NOT NULL""",
    "typography": f"""WITH {OUT}, a AS (SELECT *, regexp_split_to_array(line, '{T.PROTECTED.replace("(", "(?:", 1)}') AS s, regexp_extract_all(line, '{T.PROTECTED}') AS p
        FROM o WHERE NOT regexp_matches(line, '{T.TABLE_ROW}') AND regexp_matches(line, '[{CJK}{INVISIBLE}{WIDE}　]')),
      b AS (SELECT *, array_to_string(list_transform(s, lambda x, i: {_polish("x")} || coalesce(p[i], '')), '') AS t FROM a),
      c AS (SELECT doc_id, line_no, line, regexp_replace(regexp_replace(t, '[ \\t]{{2,}}$', '  '), '(^|[^ \\t])[ \\t]$', '\\1') AS text FROM b) SELECT doc_id, line_no, text FROM c WHERE text <> line""",
}
