"""Queries of the document writer's decisions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import snippets as P
from ..operators import wordlayout as W
from ..operators.lines import island, lines, with_fences
from ..operators.structure import TABLE_ROW
from ..sources import tables as S
from ..sources.messy import messy
from .accounts import values
from .blocks import ORACLES as BLOCKS
from .structure import HEAD
from .formatting import CODE_SQL

FAMILIES = ["Georgia", "'Microsoft YaHei'", "Unknown Face", "KaTeX_Math", '"Fira Code"', " sans-serif ", "KaTeX_Size1", "KaTeX_Main", "Songti SC", "KaTeX_SansSerif"]


def font_keys(spark, sf):
    """Faces for lists of three families, by the number of a part."""
    key = F.col("p_partkey")
    pick = lambda n: F.get(F.array(*map(F.lit, FAMILIES)), (F.floor(key / n) % len(FAMILIES)).cast("int"))
    rows = S.read(spark, sf, "part").select("p_partkey", F.concat_ws(",", pick(1), pick(10), pick(100)).alias("families"), (key % 2 == 0).alias("bold"), (key % 3 == 0).alias("italic"))
    return rows.select("p_partkey", W.font_key(F.col("families"), F.col("bold"), F.col("italic")).alias("font"))


def table_borders(spark, sf):
    rows = with_fences(lines(messy(spark, sf)), "ticks").withColumn("row", ~F.col("in_fence") & F.col("line").rlike(TABLE_ROW))
    rows = rows.withColumn("run", island(F.col("row"))).where("row")
    style = F.when(F.col("doc_id") % 3 == 0, "threeline").when(F.col("doc_id") % 3 == 1, "grid").otherwise("shaded")
    return W.cell_borders(rows.select("doc_id", "run", "line_no", style.alias("style"))).select("doc_id", "line_no", "style", "position", "top", "bottom", "sides", "colour")


def assembly_order(spark, sf):
    return W.assembled(B.blocks(messy(spark, sf)).select("doc_id", F.col("first_line").alias("ord"), "kind"))


def page_lines(spark, sf):
    """An order as a page: its items are clusters, their quantity is the top and the discount the place in the line."""
    items = S.read(spark, sf, "lineitem")
    return W.page_lines(items.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_discount").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("top"), (F.col("l_linenumber") * 2).cast("double").alias("height")))


EMPHASIS = ["**天气：**", "后记 *（参", "阅）*Z __y__。", "河边**“船”**旁 ***灯：***亮", " an **oak,** too\n_是。_k"]


def cjk_emphasis(spark, sf):
    """Whole texts with emphasis before and behind, chosen by the document's number."""
    d, k = S.read(spark, sf, "documents"), F.col("doc_id")
    pick = lambda n: F.get(F.array(*map(F.lit, EMPHASIS)), ((k / n).cast("int") % len(EMPHASIS)).cast("int"))
    text = F.concat(pick(1), "text", pick(5), F.col("n_chars").cast("string"), pick(25))
    return d.select("doc_id", W.hold_emphasis(text).alias("text"))


CODE = ["$ ls -l\n", "import math\nx = math.pi\n\n", "config = {\n  k: [1, 2]\n}\n", "git add it\ngit commit it\n", "git is a tool\n\n", "```\nimport os\ny = 1\n```\n", "console.log(1)\nz()\n# end\n"]


def code_snippets(spark, sf):
    """Documents with a piece of code, by their number, before their text."""
    piece = F.get(F.array(*map(F.lit, CODE)), (F.col("doc_id") % len(CODE)).cast("int"))
    return P.code_snippets(S.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("Start\n"), piece, "text").alias("text")))


def table_grid(spark, sf):
    """An order as a table: up to three items a row, spans by their quantity and line number."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    items = S.read(spark, sf, "lineitem")
    return P.table_grid(items.select(F.col("l_orderkey").alias("table"), F.floor((n - 1) / 3).cast("int").alias("row"), n.alias("cell"), (q % 3).alias("colspan"), ((q + n) % 4).cast("int").alias("rowspan")))


QUERIES = {f.__name__: f for f in (font_keys, table_borders, assembly_order, page_lines, cjk_emphasis, code_snippets, table_grid)}


def _listed(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _class(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '[{pattern}]')"


_CJK = W.CJK_PUNCTUATION + W.CJK_LETTERS
ORACLES = {
    "code_snippets": f"""WITH d AS (SELECT doc_id, string_split('Start' || chr(10) || {_listed(CODE)}[doc_id % {len(CODE)} + 1] || text, chr(10)) AS l FROM documents),
      l1 AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, 0 AS sub, unnest(l) AS line FROM d), {CODE_SQL}
      SELECT doc_id, k AS first_line, e AS last_line, lang AS language FROM c7 SEMI JOIN (SELECT doc_id, unnest(range(2, len(x) + 1, 2)) AS i, x[i] AS k FROM c8) USING (doc_id, k)""",
    "font_keys": f"""WITH a AS (SELECT p_partkey AS k, unnest([1, 2, 3]) AS i, unnest([1, 10, 100]) AS n FROM part), b AS (SELECT k, i, lower(trim(replace(replace({_listed(FAMILIES)}[(k // n) % {len(FAMILIES)} + 1], '"', ''), '''', ''))) AS f FROM a),
      m AS (SELECT * FROM {values(list(W.FORMULA.items()), "name, base")}),
      c AS (SELECT k, i, CASE WHEN m.base IS NOT NULL THEN m.base WHEN len(list_filter({_listed(W.SERIF)}, lambda p: starts_with(f, p))) > 0 THEN 'serif' WHEN len(list_filter({_listed(W.SANS)}, lambda p: starts_with(f, p))) > 0 THEN 'sans'
        WHEN len(list_filter({_listed(W.MONO)}, lambda p: starts_with(f, p))) > 0 THEN 'mono' END AS kind FROM b LEFT JOIN m ON m.name = b.f),
      d AS (SELECT k, coalesce(min_by(kind, i) FILTER (WHERE kind NOT IN ('serif', 'sans')), min_by(kind, i) FILTER (WHERE kind IS NOT NULL), 'sans') AS kind, k % 2 = 0 AS bold, k % 3 = 0 AS italic FROM c GROUP BY k)
      SELECT k AS p_partkey, CASE WHEN kind IN ('serif', 'sans', 'mono') THEN kind || CASE WHEN bold THEN '-bold' ELSE '' END WHEN kind = 'Math' THEN 'katex:Math-' || CASE WHEN bold THEN 'Bold' ELSE '' END || 'Italic'
        WHEN kind = 'Main' THEN 'katex:Main' || CASE WHEN bold OR italic THEN '-' ELSE '' END || CASE WHEN bold THEN 'Bold' ELSE '' END || CASE WHEN italic THEN 'Italic' ELSE '' END
        ELSE 'katex:' || kind || CASE WHEN bold AND kind IN ('Sans', 'Caligraphic') THEN '-Bold' ELSE '' END END AS font FROM d""",
    "table_borders": f"""WITH {HEAD}, t AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM f WHERE NOT in_fence AND regexp_matches(line, '{TABLE_ROW}')),
      p AS (SELECT doc_id, line_no, ['threeline', 'grid', 'shaded'][doc_id % 3 + 1] AS style, line_no = min(line_no) OVER w AS head, line_no = max(line_no) OVER w AS tail FROM t WINDOW w AS (PARTITION BY doc_id, run)),
      q AS (SELECT doc_id, line_no, style, CASE WHEN head THEN 'header' WHEN tail THEN 'last' ELSE 'body' END AS position FROM p)
      SELECT *, CASE WHEN style <> 'threeline' THEN 4 WHEN position = 'header' THEN 12 ELSE 0 END AS top, CASE style = 'threeline' WHEN true THEN CASE position WHEN 'header' THEN 4 WHEN 'last' THEN 12 ELSE 0 END ELSE CASE position WHEN 'body' THEN 4 ELSE 8 END END AS bottom,
        CASE WHEN style = 'threeline' THEN 0 ELSE 4 END AS sides, CASE WHEN style = 'threeline' THEN CASE position WHEN 'body' THEN '' ELSE '000000' END WHEN position = 'body' THEN 'D1D5DB' ELSE '9CA3AF' END AS colour FROM q""",
    "assembly_order": f"""WITH b AS ({BLOCKS["block_runs"]}), n AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS k FROM b)
      SELECT doc_id, CASE WHEN k = 1 THEN 1 ELSE k + 2 END AS place, kind AS part FROM n UNION ALL SELECT DISTINCT doc_id, 2, 'contents title' FROM b UNION ALL SELECT DISTINCT doc_id, 3, 'contents' FROM b""",
    "page_lines": """WITH RECURSIVE c AS (SELECT l_orderkey AS page, l_quantity::DOUBLE AS top, l_linenumber * 2.0 AS height, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_discount, l_linenumber) AS k FROM lineitem),
      r AS (SELECT page, k, 1 AS line, top FROM c WHERE k = 1 UNION ALL
        SELECT c.page, c.k, CASE WHEN abs(c.top - r.top) <= greatest(3, 0.6 * c.height) THEN r.line ELSE r.line + 1 END, CASE WHEN abs(c.top - r.top) <= greatest(3, 0.6 * c.height) THEN r.top ELSE c.top END FROM r JOIN c ON c.page = r.page AND c.k = r.k + 1)
      SELECT page, line, top, count(*) AS n FROM r GROUP BY ALL""",
    "cjk_emphasis": f"""WITH a AS (SELECT doc_id, {_listed(EMPHASIS)}[doc_id % 5 + 1] || text || {_listed(EMPHASIS)}[(doc_id // 5) % 5 + 1] || n_chars || {_listed(EMPHASIS)}[(doc_id // 25) % 5 + 1] AS t FROM documents),
      p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT doc_id, regexp_extract_all(t, '{W.MARKS}|[^*_]+') AS l FROM a)),
      n AS (SELECT *, regexp_matches(x, '^({W.MARKS})$') AS mark, right(lag(x) OVER w, 1) AS b, left(lead(x) OVER w, 1) AS e FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      c AS (SELECT *, coalesce({_class("b", W.PUNCTUATION)}, true) AS bp, coalesce({_class("e", W.PUNCTUATION)}, true) AS ep, b IS NOT NULL AND e IS NOT NULL AND ({_class("b", _CJK)} OR {_class("e", _CJK)}) AS cjk FROM n)
      SELECT doc_id, string_agg(CASE WHEN mark AND cjk AND bp AND NOT ep THEN '{W.HOLD}' || x WHEN mark AND cjk AND ep AND NOT bp THEN x || '{W.HOLD}' ELSE x END, '' ORDER BY i) AS text FROM c GROUP BY 1""",
}
