"""Decisions of the document writer: faces of fonts, borders of table cells, order of the parts, lines of a page, emphasis in CJK text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, trim

# Beginnings of font families by kind, and families of formula faces.
SERIF = [
    "simsun", "nsimsun", "宋体", "songti", "stsong", "fangsong", "仿宋", "kaiti", "楷体", "kaiti sc", "stkaiti",
    "noto serif", "songti sc", "georgia", "cambria", "serif", "kai", "song",
]
SANS = [
    "simhei", "黑体", "heiti", "stheiti", "heiti sc", "microsoft yahei", "微软雅黑", "yahei", "dengxian", "等线", "pingfang",
    "arial", "calibri", "helvetica", "sans-serif", "system-ui", "ui-sans-serif",
]
MONO = [
    "consolas", "jetbrains mono", "sfmono", "sf mono", "menlo", "monaco", "courier", "monospace", "source code",
    "fira code", "roboto mono", "cascadia",
]
FORMULA = {
    "katex_main": "Main",
    "katex_math": "Math",
    "katex_size1": "Size1",
    "katex_size2": "Size2",
    "katex_size3": "Size3",
    "katex_size4": "Size4",
    "katex_ams": "AMS",
    "katex_sansserif": "Sans",
    "katex_caligraphic": "Caligraphic",
    "katex_script": "Script",
    "katex_fraktur": "Fraktur",
    "katex_typewriter": "Typewriter",
}
BOLD_FORMULA = ("Sans", "Caligraphic")
# Width and colour of cell borders: style, position, top, bottom, sides, colour of the bottom.
BORDERS = [
    ("threeline", "header", 12, 4, 0, "000000"), ("threeline", "body", 0, 0, 0, ""), ("threeline", "last", 0, 12, 0, "000000"),
    ("grid", "header", 4, 8, 4, "9CA3AF"), ("grid", "body", 4, 4, 4, "D1D5DB"), ("grid", "last", 4, 8, 4, "9CA3AF"),
    ("shaded", "header", 4, 8, 4, "9CA3AF"), ("shaded", "body", 4, 4, 4, "D1D5DB"), ("shaded", "last", 4, 8, 4, "9CA3AF"),
]
# Characters beside emphasis marks. All punctuation, that of CJK text, CJK letters.
PUNCTUATION = r"!-/:-@\[-`{-~\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF01}-\x{FF65}"
CJK_PUNCTUATION = r"\x{3000}-\x{303F}\x{FF01}-\x{FF65}\x{00B7}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{2026}"
CJK_LETTERS = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
MARKS = r"\*\*|__|\*|_"
HOLD = "\u200b"


def font_key(families: Column, bold: Column, italic: Column) -> Column:
    """The face for a list of font families: a formula family or a fixed-width one decides where it comes first, else the first serif or
    sans family; unknown lists get the sans face."""
    names = F.transform(F.split(families, ","), lambda x: F.lower(trim(F.regexp_replace(x, "[\"']", ""))))
    starts = lambda x, of: F.exists(F.array(*map(F.lit, of)), lambda p: x.startswith(p))
    formula = F.create_map(*(F.lit(v) for pair in FORMULA.items() for v in pair))
    kind = lambda x: F.when(formula[x].isNotNull(), formula[x]).when(starts(x, SERIF), "serif").when(starts(x, SANS), "sans").when(starts(x, MONO), "mono")
    kinds = F.filter(F.transform(names, kind), lambda x: x.isNotNull())

    def chosen(found: Column) -> Column:
        return F.coalesce(F.get(F.filter(found, lambda x: ~x.isin("serif", "sans")), F.lit(0)), F.get(found, F.lit(0)), F.lit("sans"))

    def face(base: Column) -> Column:
        style = F.when(base == "Math", F.when(bold, "-BoldItalic").otherwise("-Italic")).when(base == "Main", F.when(bold & italic, "-BoldItalic").when(italic, "-Italic").when(bold, "-Bold").otherwise(""))
        style = style.when(base.isin(*BOLD_FORMULA) & bold, "-Bold").otherwise("")
        return F.when(base.isin("serif", "sans", "mono"), F.concat(base, F.when(bold, "-bold").otherwise(""))).otherwise(F.concat(F.lit("katex:"), base, style))

    return let(let(kinds, chosen), face)


def cell_borders(rows: DataFrame) -> DataFrame:
    """Adds position, top, bottom, sides and colour to rows (doc_id, run, line_no, style) of tables: the first row of a run is its header."""
    w = Window.partitionBy("doc_id", "run").orderBy("line_no")
    first, last = F.lag("line_no").over(w).isNull(), F.lead("line_no").over(w).isNull()
    styles = rows.sparkSession.createDataFrame(BORDERS, "style string, position string, top int, bottom int, sides int, colour string")
    placed = rows.withColumn("position", F.when(first, "header").when(last, "last").otherwise("body"))
    return placed.join(F.broadcast(styles), ["style", "position"])  # nine rows


def assembled(blocks: DataFrame) -> DataFrame:
    """Parts of a document in order: its first block, the title and field of the contents, the other blocks. blocks: doc_id, ord, kind;
    a document without blocks has no contents."""
    blocks = blocks.withColumn("first", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) == 1)
    parts = F.when(F.col("first"), F.array(F.col("kind"), F.lit("contents title"), F.lit("contents"))).otherwise(F.array("kind"))
    rows = blocks.select("doc_id", "ord", F.posexplode(parts).alias("k", "part"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "k")).alias("place"), "part")


def page_lines(clusters: DataFrame) -> DataFrame:
    """Lines of a page's clusters: page, line, top, n. A cluster, in order of top and x, is on the current line if its top is off that of
    the line's first cluster by no more than 3 or 0.6 of the cluster's height. clusters: page, id, x, top, height."""
    ordered = clusters.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("top", "x", "id", "height"))).alias("c"))
    zero = F.array().cast("array<struct<line:int,top:double>>")

    def step(lines: Column, c: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        same = F.coalesce(F.abs(c["top"] - last["top"]) <= F.greatest(F.lit(3.0), c["height"] * 0.6), F.lit(False))
        new = F.struct((F.coalesce(last["line"], F.lit(0)) + F.when(same, 0).otherwise(1)).alias("line"), F.when(same, last["top"]).otherwise(c["top"]).alias("top"))
        return F.concat(lines, F.array(new))

    placed = ordered.select("page", F.explode(F.aggregate("c", zero, step)).alias("l"))
    return placed.groupBy("page", "l.line", "l.top").agg(F.count("*").alias("n"))


def hold_emphasis(text: Column) -> Column:
    """Puts an invisible character inside emphasis marks that stand between punctuation and something else, where one neighbour is CJK:
    before a mark that follows punctuation, behind one that precedes it. Marks are taken from the left, two characters first."""
    side, escape = "\x01", "\x02"
    # the text's own control characters are spelled out, so that they stay; neither spelling is punctuation or CJK
    marked = F.replace(F.replace(text, F.lit(escape), F.lit(f"{escape}b")), F.lit(side), F.lit(f"{escape}a"))
    # as MARKS has it, and what stands before a mark behind its side: both begin with a character, which is soon not found
    marked = F.regexp_replace(marked, r"([*_](?:(?<=[*])[*]|(?<=_)_)?)", f"{side}$1{side}")
    other = f"[^{PUNCTUATION}{side}]"
    p, c, letters = PUNCTUATION, CJK_PUNCTUATION, CJK_LETTERS
    cjk = f"{c}{letters}"
    mark = lambda *before: f"{side}(?<={'|'.join(b + side for b in before)})({MARKS}){side}"
    # a mark's own characters are punctuation: beside another mark stands its side, then the mark
    closing = [(mark(f"[{p}&&[{cjk}]]") + f"(?={other})", f"{HOLD}$1"), (mark(f"[{p}]", f"[*_]{side}") + f"(?=[{cjk}&&[^{p}]])", f"{HOLD}$1")]
    opening = [(mark(f"[{cjk}&&[^{p}]]") + rf"(?=[{p}]|{side}[*_])", f"$1{HOLD}"), (mark(other) + f"(?=[{p}&&[{cjk}]])", f"$1{HOLD}")]
    for pattern, new in closing + opening:
        marked = F.regexp_replace(marked, pattern, new)
    bare = F.replace(marked, F.lit(side), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{escape}a"), F.lit(side)), F.lit(f"{escape}b"), F.lit(escape))
