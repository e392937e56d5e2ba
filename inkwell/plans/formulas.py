"""Queries of formula repair, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import formulas as P
from ..operators import mangled as M
from ..operators import matching as C
from ..operators import spans as H
from ..sources.messy import quote
from ..sources.tables import read, stored
from . import sqltext as Q

#: Lines with formulas before each text, by the document's number; two texts give their words to formulas.
FORMULAS = ["$a+b$ and $a + b$, $a+b+c$\n$$\nx_1 = \\foo{2}\n$$\n", "$q$ $qq$ $q$ $qqq$ $pq$\n", "$$u=vu=v$$ then $u=v$ or $v$\n$v$\n"]


def formula_lines(spark, sf):
    """Formulas of the texts, in their order: doc_id, ord, formula, line. They are stored, because matching reads them many times, which would cut
    all texts again each time."""
    d = read(spark, sf, "documents")
    head = F.get(F.array(*map(F.lit, FORMULAS)), (F.col("doc_id") % len(FORMULAS)).cast("int"))
    word = F.regexp_replace(F.substring("text", 1, 12), "[^a-zA-Z]", "")
    own = F.concat(F.lit("$"), word, F.lit("=1$ $"), F.substring(word, 1, 4), F.lit("x$\n"))
    found = P.formulas(d.select("doc_id", F.concat(head, own, "text").alias("text")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "formula", "is_block"))
    return stored(found.select("doc_id", place.alias("ord"), "formula", F.col("line").cast("long").alias("line")), "formula-lines")


def degraded(pool):
    """What an export that can't keep every formula reports, last formula first: some of them cut to their first half, as a repair does."""
    cut = F.when((F.col("doc_id") + F.col("ord")) % 2 == 0, F.expr("left(formula, (length(formula) + 1) div 2)")).otherwise(F.col("formula"))
    return pool.where("ord % 4 <> 3").select("doc_id", (100000 - F.col("ord")).alias("ord"), cut.alias("formula"))


def degraded_formulas(spark, sf):
    pool = formula_lines(spark, sf)
    return C.matched(degraded(pool), pool)


def export_quality(spark, sf):
    pool = formula_lines(spark, sf)
    return C.export_quality(C.matched(degraded(pool), pool), pool)


def mangled_formulas(spark, sf):
    return M.mangled_formulas(read(spark, sf, "documents"))


#: Pieces with formulas of all forms, one in another, and some that are none.
SPANS = ["a $x$ b $$y$$ c\n", "\\[ u $v$ \\] and \\\\(w\\\\) or $ no $ $5\n", "$$p \\[q\\] r$$ $$ $s$t$\n", "$k$$ $$$l$ \\(m(n)\\) \\[\no\n\\]\n", "κ $κ=125\\kappa=125κ=125$ end\n"]
#: Paragraphs with escaped tables; W stands for words of the text.
TABLES = ["<p>&lt;table&gt;&lt;tr&gt;&lt;td&gt;W&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;</p>", "<p>W &lt;TABLE class=&quot;a&quot;&gt;&lt;tr&gt;&lt;th&gt;1 &amp;amp; 2&lt;/th&gt;&lt;/tr&gt;&lt;/TABLE&gt; end</p>", "<p>W &lt;table&gt;no rows&lt;/table&gt;</p>", "<p>W</p><p>\n &lt;table &gt;x&lt;/table&gt; </p>", "W &lt;table&gt;"]


def _chosen(options):
    return F.get(F.array(*map(F.lit, options)), (F.col("doc_id") % len(options)).cast("int"))


def placeholder_text(spark, sf):
    """Texts with their formulas set aside."""
    return H.set_aside(read(spark, sf, "documents").select("doc_id", F.concat(_chosen(SPANS), "text").alias("text"))).select("doc_id", "text", F.size("spans").cast("long").alias("n_spans"))


def placeholder_formulas(spark, sf):
    return H.stored_formulas(H.set_aside(read(spark, sf, "documents").select("doc_id", F.concat(_chosen(SPANS), "text").alias("text"))))


def hoisted_tables(spark, sf):
    html = F.concat(F.replace(_chosen(TABLES), F.lit("W"), F.substring("text", 1, 30)), F.lit("<p>"), "text", F.lit("</p>"))
    return read(spark, sf, "documents").select("doc_id", H.hoist_tables(html).alias("html"))


QUERIES = {f.__name__: f for f in (mangled_formulas, degraded_formulas, export_quality, placeholder_text, placeholder_formulas, hoisted_tables)}

_NAMES = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in M.NAMES.items())
_BARE = rf"'[{WS}\\_^{{}}]', '', 'g'"


def _score(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '\\\\[a-zA-Z]+') THEN 2 ELSE 0 END + CASE WHEN regexp_matches({x}, '[_^]') THEN 2 ELSE 0 END)"


#: The places of cuts as a relation, joined with itself by where a second cut makes two pieces of one length.
REPAIR = rf"""names(ch, name) AS (VALUES {_NAMES}),
c AS (SELECT doc_id, kind, i, coalesce(name, u.ch) AS m FROM (SELECT doc_id, kind, unnest(string_split(formula, '')) AS ch, unnest(range(1, length(formula) + 1)) AS i FROM g) u LEFT JOIN names USING (ch)),
e AS (SELECT *, regexp_replace(m, {_BARE}) AS k FROM c),
t AS (SELECT doc_id, kind, max(i) AS n, string_agg(k, '' ORDER BY i) AS key, sum(length(m)) AS total FROM e GROUP BY 1, 2),
p AS (SELECT doc_id, kind, i, sum(length(m)) OVER o AS p, sum(length(k)) OVER o AS q FROM e WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
h AS (SELECT p.*, n, key, total FROM p JOIN t USING (doc_id, kind) WHERE n BETWEEN 6 AND 1200 AND length(key) >= 12 AND i BETWEEN 4 AND n - 4),
x AS (SELECT a.*, b.i AS j, b.p AS p2, b.q AS q2 FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.kind = b.kind AND b.p = 2 * a.p AND b.i >= a.i + 4
    UNION SELECT a.*, b.i, b.p, b.q FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.kind = b.kind AND b.p = a.total - a.p AND b.i >= a.i + 4
    UNION SELECT a.*, b.i, b.p, b.q FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.kind = b.kind AND 2 * b.p = a.total + a.p AND b.i >= a.i + 4),
y AS (SELECT *, p2 = 2 * p AND substr(key, 1, q::INT) = substr(key, q::INT + 1, (q2 - q)::INT) AS e12,
    total - p2 = p AND substr(key, 1, q::INT) = substr(key, q2::INT + 1) AS e13,
    p2 - p = total - p2 AND substr(key, q::INT + 1, (q2 - q)::INT) = substr(key, q2::INT + 1) AS e23 FROM x),
z AS (SELECT doc_id, kind, i, j, CASE WHEN e12 AND e13 THEN -1 WHEN e12 THEN 2 WHEN e13 THEN 1 ELSE 0 END AS odd FROM y WHERE e12 OR e13 OR e23
    QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY odd < 0, i, j) = 1),
b AS (SELECT doc_id, kind, i FROM h WHERE 2 * p = total AND substr(key, 1, q::INT) = substr(key, q::INT + 1)),
l AS (SELECT g.doc_id, g.kind, g.formula, t.key, z.odd, coalesce(z.i, b.i) AS i, CASE WHEN z.i IS NULL THEN [substr(formula, 1, b.i), substr(formula, b.i + 1)]
    ELSE [substr(formula, 1, z.i), substr(formula, z.i + 1, z.j - z.i), substr(formula, z.j + 1)] END AS pieces
    FROM g LEFT JOIN t USING (doc_id, kind) LEFT JOIN z USING (doc_id, kind) LEFT JOIN b USING (doc_id, kind)),
v AS (SELECT doc_id, kind, k, piece, coalesce(k = odd AND {_score("piece")} > 0 AND length(own) >= length(own_of_other), false) AS chosen, {_score("piece")} AS score
    FROM (SELECT doc_id, kind, odd, k, piece, length(piece), own, arg_min(own, k) FILTER (WHERE k <> odd) OVER (PARTITION BY doc_id, kind) AS own_of_other
        FROM (SELECT r.*, (SELECT string_agg(regexp_replace(coalesce(name, u.ch), {_BARE}), '' ORDER BY u.at) FROM (SELECT unnest(string_split(r.piece, '')) AS ch, unnest(range(length(r.piece))) AS at) u LEFT JOIN names USING (ch)) AS own
            FROM (SELECT doc_id, kind, odd, unnest(range(len(pieces))) AS k, unnest(pieces) AS piece FROM l WHERE i IS NOT NULL) r))),
w AS (SELECT doc_id, kind, piece FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY chosen DESC, score DESC, k) = 1),
rep AS (SELECT doc_id, kind, formula, l.key, CASE WHEN piece IS NULL THEN formula ELSE {Q.trim("piece")} END AS repaired FROM l LEFT JOIN w USING (doc_id, kind))"""
MANGLED = rf"""
WITH d AS (SELECT doc_id, substr(regexp_replace(text, '[ \n\t.,]', '', 'g'), 1, 9) AS w, n_chars AS n FROM documents),
s AS (SELECT doc_id, '\kappa_{{' || w || '}}\leq ' || n || '^{{2}}' AS a, 'κ' || w || '≤' || n || '2' AS b FROM d),
g AS (SELECT doc_id, unnest(range(8)) AS kind, unnest([b || a || b, a || a, a || a || a, b || b || a, a, a || b || b, b || '  ' || b, b || a]) AS formula FROM s),
{REPAIR}
SELECT doc_id, kind, formula, key, {_score("formula")}::BIGINT AS score, repaired FROM rep
"""

#: A document's formulas choose one after the other from a list of what is left.
POOL = rf"""d AS (SELECT doc_id, [{", ".join(quote(f) for f in FORMULAS)}][doc_id % 3 + 1] AS head, regexp_replace(substr(text, 1, 12), '[^a-zA-Z]', '', 'g') AS w, text FROM documents),
t AS (SELECT doc_id, head || '$' || w || '=1$ $' || substr(w, 1, 4) || 'x$' || chr(10) || text AS text FROM d),
y AS (SELECT doc_id, regexp_split_to_array(text, '[$][$](?s:.+?)[$][$]') AS part, regexp_extract_all(text, '[$][$]((?s:.+?))[$][$]', 1) AS block FROM t),
z AS (SELECT doc_id, i, part[i] AS part, block[i] AS block, 1 + coalesce(list_sum(list_transform(part[: i - 1], lambda x, k: length(x) - length(replace(x, chr(10), '')) + length(block[k]) - length(replace(block[k], chr(10), '')))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM y)),
o AS (SELECT doc_id, start + length(part) - length(replace(part, chr(10), '')) AS line, true AS is_block, block AS formula FROM z WHERE block IS NOT NULL
    UNION ALL SELECT doc_id, start + k - 1, false, unnest(regexp_extract_all(x, '[$]([^ \t\n$](?:[^$\n]*[^ \t\n$])?)[$]', 1)) FROM (SELECT doc_id, start, unnest(string_split(part, chr(10))) AS x, unnest(range(1, len(string_split(part, chr(10))) + 1)) AS k FROM z)),
pool AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, formula, is_block) AS ord, formula, line::BIGINT AS line FROM o),
bare AS (SELECT *, regexp_replace(formula, '[{WS}]', '', 'g') AS k FROM pool),
lists AS (SELECT doc_id, list({{'ord': ord, 'k': k, 'line': line}} ORDER BY ord) AS p FROM bare WHERE k <> '' GROUP BY 1),
wanted AS (SELECT *, regexp_replace(formula, '[{WS}]', '', 'g') AS k, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS step FROM (
    SELECT doc_id, 100000 - ord AS ord, CASE WHEN (doc_id + ord) % 2 = 0 THEN left(formula, (length(formula) + 1) // 2) ELSE formula END AS formula FROM pool WHERE ord % 4 <> 3)),
r(doc_id, step, ord, formula, line, used) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, '', NULL::BIGINT, []::BIGINT[] FROM lists
    UNION ALL SELECT doc_id, step, ord, formula, got.line, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.ord) END FROM (
        SELECT r.doc_id, w.step, w.ord, w.formula, r.used, coalesce(list_filter(l.p, lambda c: c.k = w.k AND NOT list_contains(r.used, c.ord))[1],
            list_filter(l.p, lambda c: w.k <> '' AND (contains(c.k, w.k) OR contains(w.k, c.k)) AND NOT list_contains(r.used, c.ord))[1]) AS got
        FROM r JOIN wanted w ON w.doc_id = r.doc_id AND w.step = r.step + 1 JOIN lists l ON l.doc_id = r.doc_id)),
m AS (SELECT doc_id, ord, formula, line FROM r WHERE step > 0)"""
def _aside(source: str, name: str, pattern: str, group: str, kind: str, real: str = "true") -> str:
    """The relation with the matches of a pattern as place holders; of these ``real`` tells which are formulas."""
    formula = f"regexp_extract(m, {quote(group)}, 1)"
    return f"""{name}0 AS (SELECT doc_id, spans, string_split_regex(text, {quote(pattern)}) AS part, regexp_extract_all(text, {quote(pattern)}) AS found FROM {source}),
{name}1 AS (SELECT *, list_transform(found, lambda m, i: CASE WHEN {real} THEN len(list_filter(found[: i], lambda m: {real})) END) AS nth, list_transform(list_filter(found, lambda m: {real}), lambda m: {formula}) AS own FROM {name}0),
{name} AS (SELECT doc_id, array_to_string(list_transform(part, lambda x, i: x || CASE WHEN i > len(found) THEN '' WHEN nth[i] IS NULL THEN found[i] ELSE '%%MATH_{kind}_' || (len(spans) + nth[i] - 1) || '%%' END), '') AS text,
    list_concat(spans, list_transform(own, lambda f: {{'is_block': {str(kind == "BLOCK").lower()}, 'formula': f}})) AS spans FROM {name}1)"""


_ONE = f"[$]([^$\\n{WS}](?:[^$\\n]*[^$\\n{WS}])?)[$]"
_IS_ONE = f"regexp_full_match(m, {quote(_ONE)})"
_BRACKET, _ROUND = r"(?s)\\{1,2}\[(.+?)\\{1,2}\]", r"\\{1,2}\(([^\n\r\x{2028}\x{2029}]+?)\\{1,2}\)"
#: Without look-around a run of several dollars, and a formula that one ends, are matched as a whole and put back.
ASIDE = f"""s0 AS (SELECT doc_id, [{", ".join(quote(x) for x in SPANS)}][doc_id % {len(SPANS)} + 1] || text AS text, []::STRUCT(is_block BOOLEAN, formula VARCHAR)[] AS spans FROM documents),
{_aside("s0", "s1", "(?s)[$][$].*?[$][$]", "(?s)[$][$](.*?)[$][$]", "BLOCK")},
{_aside("s1", "s2", _BRACKET, _BRACKET, "BLOCK")},
{_aside("s2", "s3", f"[$]{{2,}}|{_ONE.replace('(', '(?:', 1)[:-3]}[$]+", _ONE, "INLINE", _IS_ONE)},
{_aside("s3", "s4", _ROUND, _ROUND, "INLINE")}"""
_DECODED = "x"
for _entity, _character in H.ENTITIES:
    _DECODED = f"replace({_DECODED}, {quote(_entity)}, {quote(_character)})"
_PART = {i: f"regexp_extract(d, {quote(H.TABLE)}, {i})" for i in (1, 2, 3)}
_AROUND = {i: f"CASE WHEN {Q.trim(_PART[i])} = '' THEN '' ELSE '<p>' || {Q.trim(_PART[i])} || '</p>' END" for i in (1, 3)}
HOIST = f"""WITH a AS (SELECT doc_id, replace([{", ".join(quote(x) for x in TABLES)}][doc_id % {len(TABLES)} + 1], 'W', substr(text, 1, 30)) || '<p>' || text || '</p>' AS h FROM documents),
b AS (SELECT doc_id, string_split_regex(h, '(?s)<p>.*?</p>') AS part, regexp_extract_all(h, '(?s)<p>(.*?)</p>', 1) AS inner_ FROM a),
c AS (SELECT doc_id, i, part[i] AS part, inner_[i] AS x FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM b)),
e AS (SELECT *, {_DECODED} AS d FROM c),
f AS (SELECT doc_id, i, part || coalesce(CASE WHEN NOT regexp_matches(x, {quote(H.ESCAPED_TABLE)}) THEN '<p>' || x || '</p>' WHEN regexp_matches({Q.trim("d")}, {quote(f"(?is)^<table[{WS}>].*</table>$")}) THEN {Q.trim("d")}
    WHEN regexp_matches({_PART[2]}, {quote(H.CELLS)}) THEN {_AROUND[1]} || {_PART[2]} || {_AROUND[3]} ELSE '<p>' || x || '</p>' END, '') AS y FROM e)
SELECT doc_id, string_agg(y, '' ORDER BY i) AS html FROM f GROUP BY 1"""
ORACLES = {
    "placeholder_text": f"WITH {ASIDE} SELECT doc_id, text, len(spans)::BIGINT AS n_spans FROM s4",
    "placeholder_formulas": f"""WITH {ASIDE}, u AS (SELECT doc_id, unnest(range(len(spans))) AS kind, unnest(spans) AS s FROM s4), g AS (SELECT doc_id, kind, s.is_block AS is_block, {Q.trim("s.formula")} AS formula FROM u), {REPAIR}
      SELECT g.doc_id, g.kind AS n, g.is_block, g.formula, rep.repaired FROM g JOIN rep USING (doc_id, kind)""",
    "hoisted_tables": HOIST,
    "mangled_formulas": MANGLED,
    "degraded_formulas": f"WITH RECURSIVE {POOL} SELECT * FROM m",
    "export_quality": f"""WITH RECURSIVE {POOL}, g AS (SELECT doc_id, count(*) AS n, count(line) AS l, string_agg(coalesce(line::VARCHAR, '?'), ',' ORDER BY ord) AS x FROM m GROUP BY 1)
      SELECT p.doc_id, p.n AS n_formulas, coalesce(g.n, 0) AS n_degraded, coalesce(g.l, 0) AS n_located, coalesce(g.x, '') AS lines FROM (SELECT doc_id, count(*) AS n FROM pool GROUP BY 1) p LEFT JOIN g USING (doc_id)""",
}
