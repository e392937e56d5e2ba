"""DuckDB SQL of the operators that SQL can express over whole tables but that have none beside their code."""

from __future__ import annotations

#: Windows of 50 bytes as hexadecimal text; those with a smaller document go, and the pieces between are put together again.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
t AS (SELECT w.doc_id, w.i, lag(w.i) OVER o AS p, lead(w.i) OVER o AS q FROM w JOIN m USING (s) WHERE w.doc_id > m.least WINDOW o AS (PARTITION BY w.doc_id ORDER BY w.i)),
a AS (SELECT doc_id, i AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM t WHERE p IS NULL OR i - p > 50),
b AS (SELECT doc_id, i + 50 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM t WHERE q IS NULL OR q - i > 50),
s AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS e FROM a JOIN b USING (doc_id, k)),
g AS (SELECT s.doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans, string_agg(substr(d.h, (2 * e + 1)::BIGINT, (2 * (a - e))::BIGINT), '' ORDER BY k) AS kept, max(b) AS last FROM s JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(d.h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, name, w FROM (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS name, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
v AS (SELECT DISTINCT name, least(len(w), 13) AS size, array_to_string(w[i : i + 12], ' ') AS phrase FROM (SELECT name, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b)),
p AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM v))),
x AS (SELECT p.doc_id, p.i, p.size, v.name FROM p JOIN v USING (size, phrase)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM x)) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, name FROM x) GROUP BY 1),
o AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS t FROM d),
f AS (SELECT t, count(*) AS n FROM o GROUP BY 1),
r AS (SELECT item, name, t, row_number() OVER (PARTITION BY item ORDER BY coalesce(f.n, 0), t) AS k FROM (SELECT DISTINCT item, name, unnest(w) AS t FROM b) LEFT JOIN f USING (t)),
c AS (SELECT item, name, count(*) FILTER (WHERE k <= 4) AS terms, max(t) FILTER (WHERE k = 1) AS rarest FROM r GROUP BY 1, 2),
y AS (SELECT c.item, c.name, c.terms, o.doc_id, o.j FROM c JOIN o ON o.t = c.rarest),
z AS (SELECT y.item, y.name, y.terms, y.doc_id, y.j, count(DISTINCT o.t) AS found FROM y JOIN r ON r.item = y.item AND r.k BETWEEN 2 AND 4 JOIN o ON o.t = r.t AND o.doc_id = y.doc_id AND o.j BETWEEN y.j - 40 AND y.j + 40 GROUP BY ALL),
q AS (SELECT doc_id, count(DISTINCT name) AS n_near FROM (SELECT doc_id, name FROM z WHERE found = terms - 1 UNION ALL SELECT doc_id, name FROM y WHERE terms = 1) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_near, 0) AS n_near,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id)
"""


def crc32(text: str) -> str:
    """crc32 of a short ASCII text, unsigned: eight steps for each character."""
    step = "list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: xor(c >> 8, {step})))::BIGINT"


#: A run of period q has equal windows of six words at i and i + q for every i of an unbroken stretch; the least of several periods counts.
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {crc32("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
s AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM e),
v AS MATERIALIZED (
    SELECT doc_id, CASE WHEN h % 10 <> 0 THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM s),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 5)) AS i FROM v)),
m AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
t AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM k GROUP BY doc_id, q, island),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS q FROM t WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS x FROM r GROUP BY 1),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1),
o AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM v),
z AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS x FROM o ANTI JOIN z USING (doc_id, i) GROUP BY 1)
SELECT v.doc_id, coalesce(b.n, 0) AS n_runs, f.start, f.length, f.q AS period, 1000 * f.length // f.q AS exponent_milli,
       sha256(coalesce(b.x, '')) AS runs_sha256, sha256(coalesce(c.x, '')) AS collapsed_sha256
FROM v LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*"
_JWT = r"eyJ[A-Za-z0-9_-]{17,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_PROVIDER = r"(?:gh[opsu]_|github_pat_|xox[abps]-|sk-|AIza|glpat-)[A-Za-z0-9_-]{20,}"
_LOGIN = r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[^\x00-\x20:/@]{6,64}@"
_ANY = f"{_ASSIGN}|AKIA[A-Z0-9]{{16,}}|[0-9a-f]{{24,}}|{_PEM}|{_JWT}|{_PROVIDER}|{_LOGIN}|[A-Za-z0-9+/_=-]{{20,}}"


def _places(source: str, pattern: str, search: str) -> str:
    """Rows (r, source, start, f): the matches of a pattern in every text and their places."""
    return f"""SELECT r, '{search}' AS search, sum(length(f) + length(y)) OVER (PARTITION BY r ORDER BY i) - length(f) AS start, f FROM (
    SELECT r, unnest(f) AS f, unnest(y[: len(f)]) AS y, unnest(range(len(f))) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS y FROM {source}))"""


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_places("d", p, s) for p, s in ((_ASSIGN, "assign"), ("AKIA[A-Z0-9]+", "access"), ("[0-9a-f]+", "hex"), (_ANY, "any")))}),
k AS (SELECT *, CASE WHEN search <> 'any' THEN search
    WHEN regexp_full_match(f, '{_ASSIGN}') OR regexp_full_match(f, 'AKIA[A-Z0-9]{{16,}}') OR regexp_full_match(f, '[0-9a-f]{{24,}}') THEN 'none'
    WHEN regexp_full_match(f, '{_PEM}') THEN 'pem' WHEN regexp_full_match(f, '{_JWT}') THEN 'jwt'
    WHEN regexp_full_match(f, '{_PROVIDER}') THEN 'provider' WHEN regexp_full_match(f, '{_LOGIN}') THEN 'login' ELSE 'opaque' END AS kind FROM m),
s AS (SELECT r, start, start + length(f) AS stop, kind, list_position(['assign', 'access', 'hex', 'pem', 'jwt', 'provider', 'login', 'opaque'], kind) AS rank,
    CASE kind WHEN 'assign' THEN regexp_extract(f, '{_ASSIGN}', 2) ELSE f END AS secret FROM k WHERE kind <> 'none'),
c AS (SELECT s.*, d.source, d.lang FROM s JOIN d USING (r) WHERE CASE kind WHEN 'assign' THEN length(secret) >= 6 WHEN 'access' THEN length(secret) >= 20 WHEN 'hex' THEN length(secret) >= 24
    WHEN 'opaque' THEN len(regexp_extract_all(secret, '[A-Z]')) >= 2 AND len(regexp_extract_all(secret, '[a-z]')) >= 2 AND len(regexp_extract_all(secret, '[0-9]')) >= 2 AND len(list_distinct(string_split(secret, ''))) >= 12
    ELSE true END),
o AS (SELECT secret, count(*) AS owners FROM (SELECT DISTINCT secret, source FROM c) GROUP BY 1),
j AS (SELECT c.*, owners <= 2 AS live, kind || ':' || start || ':' || stop AS told FROM c JOIN o USING (secret) WHERE rank <= 3 OR owners <= 2),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS h, count(*) FILTER (WHERE live) AS l,
    string_agg(told, ',' ORDER BY start, rank) AS x, string_agg(told, ',' ORDER BY start, rank) FILTER (WHERE rank <= 3) AS y FROM j GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(y, '')) AS base_sha256, coalesce(x, '') AS spans, coalesce(l, 0) AS n_live
FROM d LEFT JOIN g USING (r)
"""

#: Features of every text; each distinct one's crc32 byte by byte over the table of 256 remainders.
OP13_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, false AS target, {_WORDS} AS w FROM documents UNION ALL SELECT NULL, true, {_WORDS} FROM benchmark),
i AS (SELECT w.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS MATERIALIZED (SELECT doc_id, target, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM i GROUP BY ALL),
t AS MATERIALIZED (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS t FROM (SELECT unnest(range(256))::UBIGINT AS i)),
h AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
r(f, h, p, c) AS (SELECT f, h, 1, 4294967295::UBIGINT FROM h
    UNION ALL SELECT f, h, p + 2, xor(c >> 8, t.t) FROM r JOIN t ON t.i = xor(c & 255, ('0x' || substr(h, p, 2))::UBIGINT) WHERE p < length(h)),
b AS MATERIALIZED (SELECT f, xor(4294967295::UBIGINT, c) % 10000 AS b FROM r WHERE p > length(h)),
n AS (SELECT b, coalesce(sum(n) FILTER (WHERE NOT target), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE target), 0)::BIGINT AS t FROM f JOIN b USING (f) GROUP BY b),
a AS (SELECT sum(s)::DOUBLE + 10000 AS s, sum(t)::DOUBLE + 10000 AS t FROM n),
g AS (SELECT b, floor(1000 * ln(((n.t + 1)::DOUBLE * a.s) / ((n.s + 1)::DOUBLE * a.t)))::BIGINT AS g FROM n, a),
x AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE NOT target GROUP BY 1),
d AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM w LEFT JOIN x USING (doc_id) WHERE NOT target),
o AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, weight + noise DESC, doc_id) AS k, 5 * count(*) FILTER (WHERE n_words >= 20) OVER () // 100 AS drawn FROM d)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND k <= drawn THEN k END AS rank FROM o
"""
