"""Queries of whole-text formatting, and their SQL."""

from __future__ import annotations

from ..functions.text import CJK, INVISIBLE, WIDE, WS
from ..operators import formatting as X
from ..operators import structure as S
from ..operators.wordfix import _URL, TAIL
from ..sources.messy import messy, quote
from . import sqltext as Q
from .structure import _polish


def format_text(spark, sf):
    """Every text of the messy view, formatted."""
    return X.formatted(messy(spark, sf))


def rejoined_paragraphs(spark, sf):
    return X.paragraphs(messy(spark, sf))


def setext(spark, sf):
    return X.setext(messy(spark, sf))


QUERIES = {f.__name__: f for f in (format_text, rejoined_paragraphs, setext)}

_O = "PARTITION BY doc_id ORDER BY line_no, sub"
_HERE = f"{_O} ROWS UNBOUNDED PRECEDING"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote(pattern)})"


def put(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(new)})"


def fenced(source: str, name: str) -> str:
    return f"""{name}_m AS (SELECT *, {has("line", f"^[{WS}]*```")} AS marker FROM {source}),
{name} AS (SELECT *, marker OR sum(marker::INT) OVER ({_HERE}) % 2 = 1 AS in_fence FROM {name}_m)"""


def inserted(before: str, line: str, after: str, source: str) -> str:
    return f"""SELECT doc_id, line_no, sub * 4 + d - 1 AS sub, line FROM (SELECT doc_id, line_no, sub, unnest([{before}, {line}, {after}]) AS line, unnest([0, 1, 2]) AS d FROM {source}) WHERE line IS NOT NULL"""


_NOISE = f"({has('line', S.PAGE_NUMBER)} OR {has('line', S.PAGE_NUMBER_CJK)})"
_KEY = f"regexp_replace(regexp_replace(x, '[:：][{WS}]*$', ''), '[{WS}]+', '', 'g')"


def keyword(x: str) -> str:
    bare = _KEY.replace("(x,", f"({x},", 1)
    names = ", ".join(quote(k) for k in S.KEYWORDS)
    return f"(CASE WHEN length({x}) > 100 THEN NULL WHEN lower({bare}) IN ({names}) THEN {bare} WHEN {has(bare, S.APPENDIX)} THEN {put(bare, S.APPENDIX, chr(92) + '1 ' + chr(92) + '2')} END)"


def capitals(x: str) -> str:
    return f"({has(x, f'^[A-Z][A-Z0-9{WS}&,' + chr(39) + '.-]{2,59}$')} AND (length({x}) >= 6 OR {has(x, f'[{WS}]')}) AND {has(x, '^.[^' + chr(92) + 'n]*[A-Z]')})"


_BLOCKED = " OR ".join([*(has("t", p) for p in (*X.STARTERS, X.SHELL, *(p for p, _, _ in X.NUMBERED))), f"{keyword('t')} IS NOT NULL", capitals("t")])
_NTH = "CASE " + " ".join(f"WHEN {has('clean', p)} THEN {i}" for i, (p, _, _) in enumerate(X.NUMBERED)) + " END"
_PREFIX = "CASE nth " + " ".join(f"WHEN {i} THEN regexp_extract(clean, {quote(p)}, 1)" for i, (p, _, _) in enumerate(X.NUMBERED)) + " END"
_LEVEL = "CASE nth " + " ".join(f"WHEN {i} THEN {n}" for i, (_, n, _) in enumerate(X.NUMBERED)) + " END"
_TYPE = "CASE nth " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, _, t) in enumerate(X.NUMBERED)) + " END"
_LISTED = " OR ".join(has("line", p) for p in (S.TABLE_ROW, S.SEPARATOR_ROW, S.ORDERED, S.UNORDERED))
_PROTECTED = S.PROTECTED.replace("(", "(?:", 1)
_NAKED = "(^|[^(<\"'\\[=\\\\])(https?://" + _URL + "+|www\\." + _URL + "+)"
_INNER = f"regexp_replace(regexp_replace({Q.trim('line')}, '^[|]', ''), '[|]$', '')"


def linked(x: str) -> str:
    head = "substr(u, 1, k)"
    kept = f"""list_max(list_filter(range(c, length(u) + 1), lambda k: k = c OR (substr(u, k, 1) = ')' AND {Q.count(head, "[(]")} >= {Q.count(head, "[)]")})))"""
    # the lists hold what stands before each link, the character right before it, and the link with how much of it is the link itself
    urls = f"""list_transform(regexp_extract_all({x}, {quote(_NAKED)}), lambda m: regexp_extract(m, {quote(_NAKED)}, 2))"""
    fronts = f"""list_transform(regexp_extract_all({x}, {quote(_NAKED)}), lambda m: regexp_extract(m, {quote(_NAKED)}, 1))"""
    keep = f"""list_transform({urls}, lambda u: (list_transform([length(u) - length(regexp_extract(u, {quote(TAIL)}))], lambda c: {kept}))[1])"""
    link = "'[' || substr(url[i], 1, kept[i]) || '](' || CASE WHEN starts_with(url[i], 'www.') THEN 'https://' ELSE '' END || substr(url[i], 1, kept[i]) || ')' || substr(url[i], kept[i] + 1)"
    return urls, fronts, keep, link


_URLS, _FRONTS, _KEPT, _LINK = linked("base")
_ITEM = f"indent || '**' || {Q.trim_end('prefix')} || '**' || substr(prefix, length({Q.trim_end('prefix')}) + 1) || substr(clean, length(prefix) + 1)"

#: Underlined titles and rule lines: from l3 to l4.
TITLES = f"""{fenced("l3", "f3")},
e1 AS (SELECT *, {Q.trim("line")} <> '' AS solid, NOT in_fence AND {has("line", X.UNDERLINE)} AS under, NOT in_fence AND NOT {has("line", X.UNDERLINE)} AND {has("line", X.RULE_LINE)} AS ruled,
    {Q.trim("line")} <> '' AND NOT in_fence AND NOT ({_LISTED}) AND NOT {has(Q.trim_start("line"), "^[#>]")} AS plain FROM f3),
e2 AS (SELECT *, coalesce(lag(under) OVER o, false) AS pu, coalesce(lead(solid) OVER o, false) AS ns, coalesce(lag(solid) OVER o, false) AS ps, coalesce(lag(ruled) OVER o, false) AS pr, coalesce(lag(plain) OVER o, false) AS pp FROM e1 WINDOW o AS ({_O})),
e3 AS (SELECT *, coalesce(lag(ps) OVER o, false) AS pps, coalesce(lag(pu) OVER o, false) AS ppu, sum((under AND NOT pu)::INT) OVER ({_HERE}) AS run FROM e2 WINDOW o AS ({_O})),
e4 AS (SELECT *, CASE WHEN pr AND NOT pps AND NOT ppu THEN 2 WHEN pp THEN 0 WHEN NOT ps THEN 1 ELSE 2 END AS finds FROM e3),
e5 AS (SELECT *, CASE WHEN under THEN (first_value(finds) OVER r + row_number() OVER r - 1) % 3 END AS state FROM e4 WINDOW r AS (PARTITION BY doc_id, under, run ORDER BY line_no, sub)),
e6 AS (SELECT *, lag(state) OVER o AS ls, lead(state) OVER o AS ns2 FROM e5 WINDOW o AS ({_O})),
l4 AS (SELECT doc_id, line_no, sub, CASE WHEN state = 0 THEN '' WHEN state = 1 THEN '---' WHEN ruled AND (NOT ps OR NOT ns OR coalesce(ls, 2) = 0) THEN '---' WHEN NOT in_fence AND ns2 = 0 THEN '# ' || {Q.trim("line")} ELSE line END AS line FROM e6),"""

FORMAT = f"""
WITH {Q.BASE.removeprefix("WITH ")}, w0 AS (SELECT doc_id, text, list_bool_and(list_transform(string_split(text, chr(10)), lambda line: {Q.trim(f"regexp_replace(line, '[{INVISIBLE}]', '', 'g')")} = '' OR {_NOISE})) AS stays FROM messy),
l0 AS (SELECT doc_id, line_no, 0 AS sub, line FROM lines WHERE doc_id IN (SELECT doc_id FROM w0 WHERE NOT stays)),
{fenced("l0", "f0")},
a1 AS (SELECT doc_id, line_no, sub, line, in_fence, {Q.trim("line")} AS t FROM f0 WHERE in_fence OR NOT {_NOISE}),
a2 AS (SELECT *, NOT in_fence AND length(t) BETWEEN 2 AND 60 AND {has("t", S.LETTER)} AS c FROM a1),
a3 AS (SELECT *, c AND sum(c::INT) OVER (PARTITION BY doc_id, t) >= 3 AND NOT {has("t", S.STARTER)} AS header FROM a2),
a4 AS (SELECT doc_id FROM a3 GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT t) FILTER (WHERE t <> '') >= 10 AND count(*) FILTER (WHERE header) > 0
    AND count(*) FILTER (WHERE header) < count(*) FILTER (WHERE t <> '') AND 100 * count(*) FILTER (WHERE header) <= 15 * count(*) FILTER (WHERE t <> '')),
b0 AS (SELECT * FROM a3 WHERE NOT (header AND doc_id IN (SELECT doc_id FROM a4))),
b1 AS (SELECT *, NOT in_fence AND t <> '' AND NOT ({_BLOCKED}) AS free FROM b0),
b2 AS (SELECT *, lag(t) OVER ({_O}) AS p, coalesce(lag(free) OVER ({_O}), false) AS pfree FROM b1),
b3 AS (SELECT *, NOT free OR NOT pfree OR {has("p", X.SENTENCE_END)} AS starts FROM b2),
b4 AS (SELECT *, NOT starts AND {has("p", "[a-zA-Z]-$")} AND {has("t", "^[a-z]")} AS broken, {has("t", "[a-zA-Z]{3}-$")} AS own FROM b3),
b5 AS (SELECT *, last_value(CASE WHEN NOT (broken AND NOT own AND {has("t", "^[a-z][a-zA-Z]*-$")}) THEN own END IGNORE NULLS) OVER ({_HERE}) AS stem FROM b4),
b6 AS (SELECT *, broken AND coalesce(lag(stem) OVER ({_O}), false) AS mended, sum(starts::INT) OVER ({_HERE}) AS part FROM b5),
b7 AS (SELECT *, coalesce(lead(mended) OVER ({_O}), false) AS drops,
    CASE WHEN starts THEN CASE WHEN in_fence THEN line ELSE {Q.trim_end("line")} END WHEN broken OR {has("p", X.DIRECT_END)} OR {has("t", f"^[{CJK}]")} THEN t ELSE ' ' || t END AS piece FROM b6),
l1 AS (SELECT doc_id, min(line_no) AS line_no, 0 AS sub, string_agg(CASE WHEN drops THEN regexp_replace(piece, '-$', '') ELSE piece END, '' ORDER BY line_no) AS line FROM b7 GROUP BY doc_id, part),
{fenced("l1", "f1")},
c1 AS (SELECT *, {Q.trim("line")} AS t, row_number() OVER ({_O}) AS k, count(*) OVER (PARTITION BY doc_id) AS n, NOT in_fence AND NOT {has("line", S.TABLE_ROW)} AND NOT {has("line", S.SEPARATOR_ROW)} AS open FROM f1),
c2 AS (SELECT *, CASE WHEN contains(line, '{{') THEN '{{' ELSE '[' END AS o FROM c1),
c3 AS (SELECT a.doc_id, a.k, min(z) AS z FROM (
    SELECT a.doc_id, a.k, b.k AS z, sum(CASE a.o WHEN '{{' THEN {Q.count("b.line", "[{{]".replace("{{", "{"))} - {Q.count("b.line", "[}]")} ELSE {Q.count("b.line", r"\[")} - {Q.count("b.line", r"\]")} END) OVER (PARTITION BY a.doc_id, a.k ORDER BY b.k) AS depth
    FROM c2 a JOIN c2 b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 WHERE a.open AND {has("a.t", r"[{\[]$")}) a WHERE depth <= 0 AND z > k GROUP BY 1, 2),
c4 AS (SELECT c2.*, c3.z AS json_end, in_fence OR t = '' OR {has("t", X.CODE_END)} OR ({has("t", f"[{CJK}]")} AND {has("t", "[。！？；]$")}) AS cstop, NOT open OR {has("t", X.SHELL_END)} OR NOT {has("t", X.SHELL)} AS sstop FROM c2 LEFT JOIN c3 USING (doc_id, k)),
c5 AS (SELECT *, coalesce(min(CASE WHEN cstop THEN k END) OVER ({_O} ROWS BETWEEN 1 FOLLOWING AND 19 FOLLOWING) - 1, least(n, k + 19)) AS cend,
    coalesce(min(CASE WHEN sstop THEN k END) OVER ({_O} ROWS BETWEEN 1 FOLLOWING AND 19 FOLLOWING) - 1, least(n, k + 19)) AS send FROM c4),
c6 AS (SELECT *, CASE WHEN json_end IS NOT NULL THEN 'json' WHEN open AND cend > k AND {has("t", X.CONSOLE)} THEN 'js' WHEN open AND cend > k AND {has("t", X.PYTHON)} THEN 'python'
    WHEN open AND {has("t", X.SHELL)} AND (send > k OR {has("t", X.DOLLAR)}) THEN 'bash' END AS lang FROM c5),
c7 AS (SELECT *, CASE lang WHEN 'json' THEN json_end WHEN 'bash' THEN send ELSE cend END AS e FROM c6),
c8 AS (SELECT doc_id, list_reduce(list_prepend([0::BIGINT], list([k::BIGINT, e::BIGINT] ORDER BY k)), lambda acc, b: CASE WHEN b[1] > acc[len(acc)] THEN list_concat(acc, b) ELSE acc END) AS x FROM c7 WHERE lang IS NOT NULL GROUP BY 1),
c9 AS (SELECT doc_id, unnest(x[2:]) AS k, unnest(range(len(x) - 1)) % 2 AS closes FROM c8),
c10 AS (SELECT c7.*, CASE WHEN s.k IS NOT NULL THEN '```' || lang END AS before, CASE WHEN z.k IS NOT NULL THEN '```' END AS after
    FROM c7 LEFT JOIN (SELECT * FROM c9 WHERE closes = 0) s USING (doc_id, k) LEFT JOIN (SELECT * FROM c9 WHERE closes = 1) z USING (doc_id, k)),
l2 AS ({inserted("before", "line", "after", "c10")}),
d1 AS (SELECT *, {has("line", f"^[{WS}]*```")} OR {has("line", S.TABLE_ROW)} OR {has("line", S.SEPARATOR_ROW)} AS untouched, regexp_split_to_array(line, {quote(_PROTECTED)}) AS s, regexp_extract_all(line, {quote(_PROTECTED)}) AS q FROM l2),
d2 AS (SELECT *, CASE WHEN {has("line", f"[{CJK}{INVISIBLE}{WIDE}　]")} THEN array_to_string(list_transform(s, lambda x, i: {_polish("x")} || coalesce(q[i], '')), '') ELSE line END AS x FROM d1),
l3 AS (SELECT doc_id, line_no, sub, CASE WHEN untouched THEN line ELSE regexp_replace(regexp_replace(x, '[ \\t]{{2,}}$', '  '), '(^|[^ \\t])[ \\t]$', '\\1') END AS line FROM d2),
{TITLES}
{fenced("l4", "f4")},
g1 AS (SELECT *, NOT in_fence AND {has("line", S.GRID_BORDER)} AS border, NOT in_fence AND {has("line", S.GRID_CONTENT)} AS content FROM f4),
g2 AS (SELECT *, border OR content AS drawn, sum((NOT (border OR content))::INT) OVER ({_HERE}) AS run, CASE WHEN content THEN list_transform(string_split({_INNER}, '|'), lambda c: {Q.trim("c")}) END AS cells FROM g1),
g3 AS (SELECT *, count(*) FILTER (WHERE content) OVER r AS n, count(*) OVER r AS whole, max(len(cells)) OVER r AS width, count(*) FILTER (WHERE content) OVER (PARTITION BY doc_id, drawn, run ORDER BY line_no, sub) AS nth FROM g2 WINDOW r AS (PARTITION BY doc_id, drawn, run)),
g4 AS (SELECT *, drawn AND n >= 2 AND n < whole AS built FROM g3),
g5 AS (SELECT *, CASE WHEN NOT built THEN line WHEN content THEN '| ' || array_to_string(list_resize(cells, width, ''), ' | ') || ' |' END AS out, CASE WHEN built AND content AND nth = 1 THEN '|' || repeat('---|', width) END AS after FROM g4),
l5 AS ({inserted("NULL", "out", "after", "g5")}),
{fenced("l5", "f5")},
h1 AS (SELECT *, in_fence OR {has("line", S.TABLE_ROW)} OR {has("line", S.SEPARATOR_ROW)} OR {has("line", X.DEFINITION)} AS kept FROM f5),
h2 AS (SELECT *, CASE WHEN kept THEN NULL WHEN {has("line", S.BOX_DONE)} THEN {put("line", S.BOX_DONE, r"\1- [x] ")} WHEN {has("line", S.BOX_OPEN)} THEN {put("line", S.BOX_OPEN, r"\1- [ ] ")} WHEN {has("line", S.BULLET)} THEN {put("line", S.BULLET, r"\1- ")} END AS box FROM h1),
h3 AS (SELECT *, NOT kept AND box IS NULL AND ({has("line", S.ORDERED)} OR {has("line", S.UNORDERED)}) AS listed, {Q.trim_start("line")} AS trimmed FROM h2),
h4 AS (SELECT *, substr(line, 1, length(line) - length(trimmed)) AS indent, {put("trimmed", X.BOLD_PREFIX, r"\1 ")} AS clean FROM h3),
h5 AS (SELECT *, kept OR box IS NOT NULL OR listed OR clean = '' OR {has("clean", "^(#|```|> )")} AS skip, CASE WHEN kept THEN {Q.trim("line")} = '' WHEN box IS NOT NULL THEN true WHEN listed THEN false ELSE clean = '' END AS through FROM h4),
h6 AS (SELECT *, CASE WHEN NOT skip THEN list_filter(list_transform(regexp_split_to_array(clean, {quote(X.COLUMN_GAP)}), lambda c: {Q.trim("c")}), lambda c: c <> '') END AS cols, CASE WHEN NOT skip THEN {_NTH} END AS nth,
    NOT skip AND {has("clean", X.QUOTE)} AS quoted, NOT skip AND {has("clean", X.REFERENCE)} AS referenced, length(clean) > 100 OR {has("clean", X.SENTENCE)} AS long FROM h5),
h7 AS (SELECT *, NOT skip AND len(cols) > 1 AND NOT {has("clean", "^[0-9]+[.]")} AS tabular, {_PREFIX} AS prefix, {_LEVEL} AS level, {_TYPE} AS kind, CASE WHEN NOT skip AND NOT quoted THEN {keyword("clean")} END AS name FROM h6),
h8 AS (SELECT *, NOT skip AND name IS NULL AND nth IS NULL AND NOT referenced AND {capitals("clean")} AS capital, sum((NOT coalesce(tabular, false))::INT) OVER ({_HERE}) AS run, skip AND {has("coalesce(box, line)", S.TABLE_ROW)} AS piped FROM h7),
h9 AS (SELECT *, coalesce(tabular, false) AND count(*) OVER (PARTITION BY doc_id, tabular, run) > 1 AS tab, sum((NOT piped)::INT) OVER ({_HERE}) AS pipes FROM h8),
h10 AS (SELECT *, count(*) OVER r AS n_pipes, count(*) FILTER (WHERE {has("line", S.SEPARATOR_ROW)}) OVER r AS n_seps, row_number() OVER (PARTITION BY doc_id, piped, pipes ORDER BY line_no, sub) AS nth_pipe, CASE WHEN NOT skip AND NOT tab THEN kind END AS type FROM h9 WINDOW r AS (PARTITION BY doc_id, piped, pipes)),
h11 AS (SELECT *, CASE WHEN NOT through THEN coalesce(type, '') END AS st FROM h10),
h12 AS (SELECT *, last_value(st IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pst, coalesce(lag(tab) OVER ({_O}), false) AS ptab FROM h11),
h13 AS (SELECT *, sum((st IS NOT NULL AND (pst IS NULL OR st <> pst OR st = ''))::INT) OVER ({_HERE}) AS grp FROM h12),
h14 AS (SELECT *, bool_or(long AND type IS NOT NULL) OVER (PARTITION BY doc_id, grp) AS items FROM h13),
h15 AS (SELECT *, CASE WHEN skip THEN coalesce(box, line) WHEN name IS NOT NULL THEN indent || '## ' || name WHEN capital THEN indent || '### ' || clean WHEN tab THEN '| ' || array_to_string(cols, ' | ') || ' |'
    WHEN type = 'bracket' AND NOT items THEN indent || '**' || clean || '**' WHEN type IS NOT NULL AND NOT items THEN indent || repeat('#', level) || ' ' || clean
    WHEN quoted THEN indent || {put("clean", X.QUOTE, r"> **\1**：")} WHEN referenced THEN indent || {put("clean", X.REFERENCE, r"**\1** ")} END AS done,
    CASE WHEN type IS NOT NULL THEN {_ITEM} ELSE line END AS base,
    CASE WHEN tab AND NOT ptab AND name IS NULL AND NOT capital THEN len(cols) WHEN piped AND nth_pipe = 1 AND n_pipes > 1 AND n_seps = 0 THEN {Q.count(_INNER, "[|]")} + 1 END AS width FROM h14),
h16 AS (SELECT *, CASE WHEN done IS NULL AND {has("base", "https?://|www[.]")} THEN {_URLS} END AS url, {_FRONTS} AS front, {_KEPT} AS kept_of, string_split_regex(base, {quote(_NAKED)}) AS pieces FROM h15),
h17 AS (SELECT *, CASE WHEN done IS NOT NULL THEN done WHEN url IS NULL THEN base ELSE array_to_string(list_transform(pieces, lambda p, i: p || CASE WHEN i <= len(url) THEN front[i] || {_LINK.replace("kept[i]", "kept_of[i]")} ELSE '' END), '') END AS out,
    CASE WHEN width IS NOT NULL THEN '|' || repeat('---|', width) END AS after FROM h16),
l6 AS ({inserted("NULL", "out", "after", "h17")}),
{fenced("l6", "f6")},
i1 AS (SELECT *, NOT in_fence AND {Q.trim("line")} = '' AS gap FROM f6),
i2 AS (SELECT *, gap AND coalesce(lag(gap) OVER ({_O}), false) AS again FROM i1)
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no, sub) AS text FROM i2 WHERE NOT again GROUP BY 1
UNION ALL SELECT doc_id, text FROM w0 WHERE coalesce(stays, true)
"""
#: Blocks of code in the lines l1: the lines with the block that each could start (c7), and the starts and ends that stand (c8).
CODE_SQL = FORMAT[FORMAT.index("f1_m AS") : FORMAT.index("c9 AS")].rstrip().rstrip(",")

ORACLES = {
    "format_text": FORMAT,
    "rejoined_paragraphs": FORMAT[: FORMAT.index("l1 AS (SELECT")].rstrip().rstrip(",").replace("FROM lines WHERE doc_id IN (SELECT doc_id FROM w0 WHERE NOT stays)", "FROM lines")
    + """ SELECT doc_id, min(line_no) AS line_no, string_agg(CASE WHEN drops THEN regexp_replace(piece, '-$', '') ELSE piece END, '' ORDER BY line_no) AS text FROM b7 GROUP BY doc_id, part HAVING count(*) > 1""",
    "setext": f"WITH {Q.BASE}, l3 AS (SELECT doc_id, line_no, 0 AS sub, line FROM lines), {TITLES.rstrip(",")} SELECT doc_id, line_no, l4.line AS text FROM l4 JOIN l3 USING (doc_id, line_no) WHERE l4.line <> l3.line",
}
