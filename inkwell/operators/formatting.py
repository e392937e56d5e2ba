"""One formatting of whole texts, made of all the structure rules.

Every rule rewrites one relation of lines, (doc_id, line_no, sub, line, rule): a row keeps the number of the line it comes from, lines that
a rule puts in before or behind stand at their neighbour's number with another ``sub``, and ``rule`` names the last rule that wrote the row. So
rules that insert, drop or join lines compose by windows over the relation, without going through text, and one ordered merge at
the end makes the documents. Documents are dealt by doc_id while each is one row; nothing is exchanged after that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import CJK, INVISIBLE, WS, count, ends, is_ascii, let, trim, trim_end, trim_start
from . import structure as S
from .lines import MARKERS, blank, dealt, lines
from .wordfix import NAKED, TAIL

# Lines that are never joined to others, and the ends that nothing is joined to.
NUMERAL = "一二三四五六七八九十"
STARTERS = [
    "^[#>*|+=—―•·Ø‣▪◦●○►➢‒–]",
    rf"^(\[x\]|\[X\]|\[ \]|☑|✓|✔|☐|□|✗|✘)([{WS}]|\z)",
    rf"^[0-9]{{1,3}}[.、)）]([{WS}]|\z)",
    rf"^(\[[0-9]+\]|\([0-9{NUMERAL}]+\)|（[0-9{NUMERAL}]+）)",
    r"^([{}\[\]<]|```|import |from |def |class |function |console\.|print\(|//|/\*|#!|[$][$]|\\\(|\\\[)",
]
SENTENCE_END = r"[。！？：；.!?:…]\z"
DIRECT_END = rf"[{CJK}，。、；：！？…）】》」』\]]\z"
# Starts of code and shell lines, and what ends a run of code.
PYTHON = rf"^(def[{WS}]+[a-zA-Z_]|import[{WS}]+[a-zA-Z]|from[{WS}]+[a-zA-Z_.]+[{WS}]+import[{WS}]|class[{WS}]+[a-zA-Z]|function[{WS}]+[a-zA-Z]|print[{WS}]*\()"
CONSOLE = rf"^console\.(log|error|warn|info|debug|table)[{WS}]*\("
DOLLAR = rf"^[$][{WS}]"
SHELL = rf"^([$][{WS}]+[^{WS}]|(npm|npx|yarn|pnpm|pip3?|python3?|node|git|docker|kubectl|curl|wget|sudo|apt(-get)?|brew|cargo)[{WS}]+[a-zA-Z])"
CODE_END = r"^[#>*0-9|-]"
SHELL_END = "^[#>*0-9-]"
#: Lines that a balanced block and a run of code may have.
BALANCED, RUN = 50, 20
# Rule lines, underlines of titles, link definitions, and a bold prefix.
RULE_LINE = r"^[ \t]*([-*_—–─·＝=][ \t]*){3,}\z"
UNDERLINE = rf"^[{WS}]*={{2,}}[{WS}]*\z"
DEFINITION = rf"^[{WS}]*\[[^\]]+\]:[{WS}]*[^{WS}]"
BOLD_PREFIX = rf"^\*\*([^*]+)\*\*[{WS}]*"
#: Numbered prefixes in order: pattern (the prefix is its first group), level, type.
NUMBERED = [
    (rf"^(第[{NUMERAL}百千万0-9]+[章节篇部分][{WS}]*)", 2, "chap"),
    (rf"(?i)^(section[{WS}]+[0-9]+(?:[.][0-9]+)?[{WS}]*)", 3, "ensec"),
    (rf"(?i)^(subsection[{WS}]+[0-9]+(?:[.][0-9]+)?[{WS}]*|(?:chapter|part)[{WS}]+[0-9]+[{WS}]*)", 2, "ensec"),
    (rf"^([{NUMERAL}]+、[{WS}]*)", 3, "zh"),
    (rf"^([IVX]{{1,6}}[.][{WS}]+)[A-Z{CJK}]", 3, "roman"),
    (rf"^([0-9]+[.][0-9]+[.][0-9]+(?:[{WS}]+|\z))", 4, "dot3"),
    (rf"^([0-9]+[.][0-9]+(?:[{WS}]+|\z))", 3, "dot2"),
    (rf"^([0-9]+[.])[{CJK}（「【]", 2, "dot1"),
    (rf"^([0-9]+[.](?:[{WS}]+|\z))", 2, "dot1"),
    (rf"^((?:\([0-9{NUMERAL}]+\)|[0-9]+\)|（[{NUMERAL}0-9]+）)[{WS}]*)", 0, "bracket"),
]
QUOTE = S.QUOTE[: S.QUOTE.rindex("[ ")] + f"[{WS}]*"
REFERENCE = rf"^(\[[0-9]+\])[{WS}]*"
#: Lines that are looked at first for something visible.
FIRST = 4
LONG, SENTENCE = 100, "[。！？]"
#: Starts of lines that may be more than text, wider than the patterns above and those of structure have them.
SPECIAL = (
    "(?i)^([^a-zA-Z]|page|import|from|def|class|function|print|console|npm|npx|yarn|pnpm|pip|python|node|git|docker|kubectl|curl|wget|sudo|apt|brew|cargo"
    "|section|subsection|chapter|part|note|tip|warning|caution|important|example|[ivx]{1,6}[.])"
)
COLUMN_GAP, ASCII_GAP = rf"\t|[{WS}]{{2,}}", r"\t|[ \n\x0b\x0c\r]{2}"


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no", "sub")


def to_here() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def of_document() -> WindowSpec:
    return Window.partitionBy("doc_id")


def prose(x: Column) -> Column:
    """Lines that start like text: they are no page number, table row, rule line, list item, numbered title, call-out, definition or code,
    and need not be held against each of these patterns, which are tried at every character of a line. Section names and capitals may be
    among them."""
    x = trim_start(x)
    return (x != "") & ~F.left(x, F.lit(16)).rlike(SPECIAL)


def starts(x: Column, pattern: str) -> Column:
    """Whether the first character matches."""
    return F.left(x, F.lit(1)).rlike(pattern)


def is_marker(line: Column) -> Column:
    return line.contains("```") & line.rlike(MARKERS["ticks"])


def with_fences(rows: DataFrame) -> DataFrame:
    """Adds marker, in_fence and k, the line's number."""
    rows = rows.withColumn("marker", is_marker(F.col("line")))
    opened = F.sum(F.col("marker").cast("int")).over(to_here())
    return rows.withColumns({"in_fence": F.col("marker") | (opened % 2 == 1), "k": F.row_number().over(in_order())})


def relation(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "line_no", "sub", "line", "rule")


def written(rows: DataFrame, rule: str, new: Column) -> DataFrame:
    """The relation with ``new`` as the line, where it isn't null."""
    rows = rows.withColumn("new", new)
    changed = F.col("new").isNotNull() & (F.col("new") != F.col("line"))
    return relation(rows.withColumn("rule", F.when(changed, rule).otherwise(F.col("rule"))).withColumn("line", F.coalesce("new", "line")))


def inserted(rows: DataFrame, rule: str, before: Column, after: Column) -> DataFrame:
    """The relation with the lines ``before`` and ``after`` around a row, where they aren't null. A null line goes."""
    place = lambda n, line, by: F.struct((F.col("sub") * 4 + n).alias("sub"), line.alias("line"), by.alias("rule"))
    each = F.array(place(-1, before, F.lit(rule)), place(0, F.col("line"), F.col("rule")), place(1, after, F.lit(rule)))
    rows = rows.select("doc_id", "line_no", F.explode(F.filter(each, lambda x: x.line.isNotNull())).alias("x"))
    return rows.select("doc_id", "line_no", "x.sub", "x.line", "x.rule")


def without_noise(rows: DataFrame) -> DataFrame:
    """Page numbers and repeated headers go, as structure.page_number_noise and structure.repeated_headers have it."""
    rows = rows.where(F.col("in_fence") | prose(F.col("line")) | ~S.is_page_number(F.col("line"))).withColumn("t", trim(F.col("line")))
    candidate = ~F.col("in_fence") & F.length("t").between(2, 60) & F.col("t").rlike(S.LETTER)
    same = Window.partitionBy("doc_id", "t")
    rows = rows.withColumns({"times": F.sum(candidate.cast("int")).over(same), "first": (F.col("line_no") == F.min("line_no").over(same)) & (F.col("t") != "")})
    rows = rows.withColumn("header", candidate & (F.col("times") >= 3) & ~F.col("t").rlike(S.STARTER))
    total = lambda flag: F.count_if(flag).over(of_document())
    rows = rows.withColumns({"n": F.count("*").over(of_document()), "solid": total(F.col("t") != ""), "kinds": total(F.col("first")), "headers": total(F.col("header"))})
    few = F.expr("n >= 30 AND kinds >= 10 AND headers > 0 AND headers < solid AND 100 * headers <= 15 * solid")
    return rows.where(~(F.col("header") & few))


def numbered(x: Column) -> Column:
    """Prefix, level and type of a numbered title or item; null if it has no number."""
    kinds = [(F.regexp_extract(x, p, 1), p, level, kind) for p, level, kind in NUMBERED]
    return reduce(lambda c, k: c.when(x.rlike(k[1]), F.struct(k[0].alias("prefix"), F.lit(k[2]).alias("level"), F.lit(k[3]).alias("type"))), kinds, F)


def keyword(x: Column) -> Column:
    """The section name that a line is as a whole, without blanks and final colon; else null."""
    bare = F.regexp_replace(F.regexp_replace(x, f"[:：][{WS}]*\\z", ""), f"[{WS}]+", "")
    name = lambda b: F.when(F.lower(b).isin(*S.KEYWORDS), b).when(b.rlike(S.APPENDIX), F.regexp_replace(b, S.APPENDIX, "$1 $2"))
    return F.when((F.length(x) <= 100) & x.rlike(S.SHORT), let(bare, name))


def capitals(x: Column) -> Column:
    return (F.length(x) <= 60) & x.rlike(f"^[A-Z][A-Z0-9{WS}&,'.-]{{2,59}}\\z") & ((F.length(x) >= 6) | x.rlike(f"[{WS}]")) & x.rlike("^.[^\n]*[A-Z]")


def blocked(x: Column) -> Column:
    """Lines, without blanks around, that stay on their own."""
    special = reduce(lambda a, b: a | b, (x.rlike(p) for p in [*STARTERS, SHELL, *(p for p, _, _ in NUMBERED)]))
    return (~prose(x) & special) | keyword(x).isNotNull() | capitals(x)


def rejoined(rows: DataFrame) -> DataFrame:
    """Wrapped lines joined to paragraphs.

    A hyphen between a letter and a small letter goes if three letters or more stand before it in the joined text. Those can come from several
    lines: a line that is letters and a hyphen only passes on what it got if the hyphen before it went, and any other line decides by
    its own end; so a line's state is that of the last line that decides for itself."""
    rows = rows.withColumn("t", trim(F.col("line")))
    rows = rows.withColumn("free", ~F.col("in_fence") & (F.col("t") != "") & ~blocked(F.col("t")))
    w = in_order()
    rows = rows.withColumns({"before": F.lag("t").over(w), "free_before": F.lag("free", 1, False).over(w)})
    before = F.col("before")
    rows = rows.withColumn("starts", ~F.col("free") | ~F.col("free_before") | ends(before, 1, SENTENCE_END))
    rows = rows.withColumn("broken", ~F.col("starts") & ends(before, 2, r"[a-zA-Z]-\z") & starts(F.col("t"), "^[a-z]"))
    rows = rows.withColumn("direct", ends(before, 1, DIRECT_END) | starts(F.col("t"), f"^[{CJK}]"))
    own = ends(F.col("t"), 4, r"[a-zA-Z]{3}-\z")
    passes = F.col("broken") & ~own & F.col("t").rlike(r"^[a-z][a-zA-Z]*-\z")
    stem = F.last(F.when(~passes, own), ignorenulls=True).over(to_here())
    rows = rows.withColumns({"stem": stem, "next_broken": F.lead("broken").over(w), "part": F.sum(F.col("starts").cast("int")).over(to_here())})
    # the hyphen at the next line's start goes by the stem up to this line
    rows = rows.withColumn("next_mended", F.coalesce("next_broken", F.lit(False)) & F.coalesce("stem", F.lit(False)))
    whole = F.when(F.col("in_fence"), F.col("line")).otherwise(trim_end(F.col("line")))
    text = F.when(F.col("starts"), whole).when(F.col("broken") | F.col("direct"), F.col("t")).otherwise(F.concat(F.lit(" "), F.col("t")))
    rows = rows.withColumn("piece", F.when(F.col("next_mended"), F.regexp_replace(text, r"-\z", "")).otherwise(text))
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    parts = rows.groupBy("doc_id", "part").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.array_join(F.transform(pieces, lambda s: s.piece), "").alias("line"), F.first("rule").alias("rule"))
    return relation(parts.withColumn("sub", F.lit(0)).withColumn("rule", F.when(F.col("n") > 1, "rejoin").otherwise(F.col("rule"))))


def code_blocks(rows: DataFrame) -> DataFrame:
    """Adds k, the line's number, and block: end and lang of the block of JSON, code or shell lines that starts with the line; ends: whether one
    ends with it.

    Each line that could start a block gets the end its block would have. A block that starts inside a chosen one isn't looked at, so
    overlapping candidates form clusters, and each cluster is folded on its own."""
    rows = with_fences(rows).withColumn("t", trim(F.col("line")))
    rows = rows.withColumn("prose", prose(F.col("line")))
    pipes = F.col("line").rlike(S.TABLE_ROW) | F.col("line").rlike(S.SEPARATOR_ROW)
    rows = rows.withColumn("open", ~F.col("in_fence") & (F.col("prose") | ~pipes))
    rows = rows.withColumn("opens", F.col("open") & ends(F.col("t"), 1, r"[{\[]\z")).withColumns({"last": F.count("*").over(of_document()), "some": F.max("opens").over(of_document())})
    # a block of braces ends at the first line where no more are open than before its start
    ahead = in_order().rowsBetween(1, BALANCED - 1)
    own = lambda opening, closing: F.when(F.col("some"), count(F.col("line"), opening) - count(F.col("line"), closing))
    rows = rows.withColumn("own_braces", own("[{]", "[}]")).withColumn("own_squares", own(r"\[", r"\]"))
    rows = rows.withColumns({name: F.sum(f"own_{name}").over(to_here()) for name in ("braces", "squares")})
    sentence = ends(F.col("t"), 1, r"[。！？；]\z") & F.col("t").rlike(f"[{CJK}]")
    rows = rows.withColumn("code_stop", F.col("in_fence") | (F.col("t") == "") | starts(F.col("t"), CODE_END) | sentence)
    rows = rows.withColumn("shell_stop", F.col("prose") | ~F.col("open") | starts(F.col("t"), SHELL_END) | ~F.col("t").rlike(SHELL))
    near = in_order().rowsBetween(1, RUN - 1)
    stop = lambda name: F.min(F.when(F.col(f"{name}_stop"), F.col("k"))).over(near)
    rows = rows.withColumns({f"next_{name}": F.collect_list(name).over(ahead) for name in ("braces", "squares")} | {f"next_{name}": stop(name) for name in ("code", "shell")})
    closing = lambda name: F.array_position(F.transform(f"next_{name}", lambda d: d <= F.col(name) - F.col(f"own_{name}")), True)
    length = F.when(F.col("line").contains("{"), closing("braces")).otherwise(closing("squares"))
    rows = rows.withColumn("json_end", F.when(F.col("opens") & (length > 0), F.col("k") + length))
    end = lambda name: F.coalesce(F.col(f"next_{name}") - 1, F.least(F.col("last"), F.col("k") + RUN - 1))
    rows = rows.withColumn("code_end", end("code")).withColumn("shell_end", end("shell"))
    found = lambda stop, lang: F.struct(F.col("k").alias("k"), stop.cast("int").alias("end"), F.lit(lang).alias("lang"))
    more, coded = F.col("code_end") > F.col("k"), F.col("open") & ~F.col("prose")
    block = (
        F.when(F.col("json_end").isNotNull(), found(F.col("json_end"), "json"))
        .when(coded & F.col("t").rlike(CONSOLE) & more, found(F.col("code_end"), "js"))
        .when(coded & F.col("t").rlike(PYTHON) & more, found(F.col("code_end"), "python"))
        .when(coded & F.col("t").rlike(SHELL) & ((F.col("shell_end") > F.col("k")) | F.col("t").rlike(DOLLAR)), found(F.col("shell_end"), "bash"))
    )
    rows = rows.withColumn("block", block)
    reach = F.max("block.end").over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("covered", F.coalesce(F.col("k") <= reach, F.lit(False)))
    rows = rows.withColumn("cluster", F.count_if(F.col("block").isNotNull() & ~F.col("covered")).over(to_here()))
    rows = rows.withColumn("cluster", F.when(F.col("block").isNotNull() | F.col("covered"), F.col("cluster")))
    rows = rows.withColumn("blocks", F.collect_list("block").over(Window.partitionBy("doc_id", "cluster")))
    first = F.struct(F.lit(0).alias("to"), F.filter("blocks", lambda b: F.lit(False)).alias("kept"))
    step = lambda acc, b: F.when(b.k > acc.to, F.struct(b.end.alias("to"), F.concat(acc.kept, F.array(b)).alias("kept"))).otherwise(acc)
    chosen = F.aggregate(F.array_sort("blocks"), first, step, lambda acc: acc.kept)
    rows = rows.withColumn("chosen", F.when(F.size("blocks") > 0, chosen))
    own = F.get(F.filter("chosen", lambda b: b.k == F.col("k")), F.lit(0))
    return rows.withColumn("block", own).withColumn("ends", F.exists("chosen", lambda b: b.end == F.col("k")))


def with_code(rows: DataFrame) -> DataFrame:
    """Fences around blocks of code."""
    return inserted(code_blocks(rows), "code", F.concat(F.lit("```"), "block.lang"), F.when(F.col("ends"), "```"))


def with_typography(rows: DataFrame) -> DataFrame:
    """Typography of lines that are neither fence markers nor table rows."""
    line = F.col("line")
    untouched = ~prose(line) & (is_marker(line) | line.rlike(S.TABLE_ROW) | line.rlike(S.SEPARATOR_ROW))
    trailing = F.regexp_replace(F.regexp_replace(line, r"[ \t]{2,}\z", "  "), r"(^|[^ \t])[ \t]\z", "$1")
    polished = F.when(line.rlike(S.TOUCHED), S.polished(line)).otherwise(line)
    return written(rows, "typography", F.when(untouched, line).when(S.has_typography(line), polished).when(ends(line, 1, r"[ \t]\z"), trailing).otherwise(line))


def with_titles(rows: DataFrame) -> DataFrame:
    """Underlined titles and rule lines.

    An underline below plain text makes it a title and becomes blank; below a blank line it becomes a rule; else it stays, and counts as
    plain text for an underline below it. So in a run of underlines these three follow each other, from what the first one finds."""
    rows = with_fences(rows).withColumn("solid", ~blank(F.col("line"))).withColumn("prose", prose(F.col("line")))
    looked = ~F.col("in_fence") & ~F.col("prose")
    rows = rows.withColumn("under", looked & F.col("line").rlike(UNDERLINE)).withColumn("ruled", looked & ~F.col("line").rlike(UNDERLINE) & F.col("line").rlike(RULE_LINE))
    listed = reduce(lambda a, b: a | b, (F.col("line").rlike(p) for p in (S.TABLE_ROW, S.SEPARATOR_ROW, S.ORDERED, S.UNORDERED)))
    rows = rows.withColumn("plain", F.col("solid") & ~F.col("in_fence") & (F.col("prose") | (~listed & ~starts(trim_start(F.col("line")), "^[#>]"))))
    w = in_order()
    beside = {f"{c}_before": F.lag(c, 1, False).over(w) for c in ("under", "solid", "ruled", "plain")}
    beside |= {f"{c}_ahead": F.lag(c, 2, False).over(w) for c in ("under", "solid")}
    rows = rows.withColumns(beside | {"solid_after": F.lead("solid", 1, False).over(w)})
    rows = rows.withColumn("heads", F.col("under") & ~F.col("under_before"))
    # a rule line next to blank becomes a rule before its underline looks at it; that its own line before can be an emptied underline is told below
    finds = F.when(F.col("ruled_before") & ~F.col("solid_ahead") & ~F.col("under_ahead"), 2).when(F.col("plain_before"), 0).when(~F.col("solid_before"), 1).otherwise(2)
    rows = rows.withColumn("head", F.last(F.when(F.col("heads"), F.struct(finds.alias("finds"), "k")), ignorenulls=True).over(to_here()))
    rows = rows.withColumn("state", F.when(F.col("under"), (F.col("head.finds") + F.col("k") - F.col("head.k")) % 3))
    rows = rows.withColumns({"state_before": F.lag("state").over(w), "state_after": F.lead("state").over(w)})
    ruled = F.col("ruled") & (~F.col("solid_before") | ~F.col("solid_after") | (F.coalesce("state_before", F.lit(2)) == 0))
    title = F.concat(F.lit("# "), trim(F.col("line")))
    new = F.when(F.col("state") == 0, "").when(F.col("state") == 1, "---").when(ruled, "---").when(~F.col("in_fence") & (F.col("state_after") == 0), title)
    return written(rows, "title", new)


def paragraphs(docs: DataFrame) -> DataFrame:
    """The paragraphs that rejoined() makes of several lines: doc_id, line_no (of the first), text."""
    rows = lines(dealt(docs), state=False).select("doc_id", "line_no", F.lit(0).alias("sub"), "line", F.lit(None).cast("string").alias("rule"))
    made = rejoined(without_noise(with_fences(rows)))
    return made.where("rule = 'rejoin'").select("doc_id", "line_no", F.col("line").alias("text"))


def setext(docs: DataFrame) -> DataFrame:
    """The lines that with_titles() writes: doc_id, line_no, text."""
    rows = lines(dealt(docs), state=False).select("doc_id", "line_no", F.lit(0).alias("sub"), "line", F.lit(None).cast("string").alias("rule"))
    return with_titles(rows).where("rule IS NOT NULL").select("doc_id", "line_no", F.col("line").alias("text"))


def with_grids(rows: DataFrame) -> DataFrame:
    """Tables drawn with borders as pipe rows, as structure.grid_tables has it."""
    rows = with_fences(rows)
    rows = rows.withColumn("border", ~F.col("in_fence") & F.col("line").contains("+") & F.col("line").rlike(S.GRID_BORDER)).withColumn("content", ~F.col("in_fence") & F.col("line").contains("|") & F.col("line").rlike(S.GRID_CONTENT))
    drawn = F.col("border") | F.col("content")
    rows = rows.withColumn("run", F.when(drawn, F.sum((~drawn).cast("int")).over(to_here())))
    inner = F.regexp_replace(F.regexp_replace(trim(F.col("line")), "^[|]", ""), r"[|]\z", "")
    rows = rows.withColumn("cells", F.when(F.col("content"), F.transform(F.split(inner, "[|]", -1), trim)))
    run = Window.partitionBy("doc_id", "run")
    first = F.min(F.when(F.col("content"), F.col("k"))).over(run)
    rows = rows.withColumn("n_cells", F.size("cells"))
    rows = rows.withColumns({"n": F.count_if("content").over(run), "whole": F.count("*").over(run), "width": F.max("n_cells").over(run), "first": F.col("k") == first})
    built = F.col("run").isNotNull() & (F.col("n") >= 2) & (F.col("n") < F.col("whole"))
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.col("n_cells")))
    row = F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))
    rows = rows.withColumn("built", built).withColumn("line", F.when(~F.col("built"), F.col("line")).when(F.col("content"), row))
    rows = rows.withColumn("rule", F.when(F.col("built"), "grid").otherwise(F.col("rule")))
    separator = F.when(F.col("built") & F.col("first"), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("width"))))
    return inserted(rows, "grid", F.lit(None).cast("string"), separator)


def linked(line: Column) -> Column:
    """Naked links as links; punctuation behind one stays outside, unless it is a bracket that the link itself opens."""

    def link(url: Column) -> Column:
        core = F.length(url) - F.length(F.regexp_extract(url, f"({TAIL})", 1))
        head = lambda i: F.substring(url, F.lit(1), i)
        opened = lambda i: (F.substring(url, i, F.lit(1)) == ")") & (F.regexp_count(head(i), F.lit("[(]")) >= F.regexp_count(head(i), F.lit("[)]")))
        kept = F.array_max(F.filter(F.sequence(core, F.length(url)), lambda i: (i == core) | opened(i)))
        target = lambda bare: F.when(bare.startswith("www."), F.concat(F.lit("https://"), bare)).otherwise(bare)
        return let(kept, lambda n: F.concat(F.lit("["), head(n), F.lit("]("), target(head(n)), F.lit(")"), F.substring(url, n + 1, F.length(url))))

    parts, urls = F.split(line, NAKED, -1), F.regexp_extract_all(line, F.lit(f"({NAKED})"), F.lit(1))
    mended = F.array_join(F.zip_with(parts, urls, lambda p, u: F.concat(p, F.coalesce(link(u), F.lit("")))), "")
    return F.when((line.contains("://") | line.contains("www.")) & line.rlike("https?://|www[.]"), mended).otherwise(line)


def with_structure(rows: DataFrame) -> DataFrame:
    """Titles, lists, tables, call-outs, references and links, the first that fits: what is Markdown already, section names, capitals,
    tables, numbered titles, call-outs, references, numbered items and text."""
    rows = with_fences(rows)
    line = F.col("line")
    box = F.when(line.rlike(S.BOX_DONE), F.regexp_replace(line, S.BOX_DONE, "$1- [x] ")).when(line.rlike(S.BOX_OPEN), F.regexp_replace(line, S.BOX_OPEN, "$1- [ ] ")).when(line.rlike(S.BULLET), F.regexp_replace(line, S.BULLET, "$1- "))
    rows = rows.withColumn("prose", prose(line))
    kept = F.col("in_fence") | (~F.col("prose") & (line.rlike(S.TABLE_ROW) | line.rlike(S.SEPARATOR_ROW) | line.rlike(DEFINITION)))
    rows = rows.withColumn("kept", kept).withColumn("box", F.when(~F.col("kept") & ~F.col("prose"), box))
    rows = rows.withColumn("listed", ~F.col("kept") & F.col("box").isNull() & ~F.col("prose") & (line.rlike(S.ORDERED) | line.rlike(S.UNORDERED)))
    rows = rows.withColumn("trimmed", trim_start(line))
    rows = rows.withColumn("indent", line.substr(F.lit(1), F.length(line) - F.length("trimmed"))).withColumn("clean", F.when(F.col("trimmed").startswith("**"), F.regexp_replace("trimmed", BOLD_PREFIX, "$1 ")).otherwise(F.col("trimmed")))
    clean = F.col("clean")
    marked = F.col("kept") | F.col("box").isNotNull() | F.col("listed")
    rows = rows.withColumn("skip", marked | (~F.col("prose") & ((clean == "") | clean.rlike("^(#|```|> )"))))
    looked = ~F.col("skip") & ~F.col("prose")
    rows = rows.withColumn("through", F.when(F.col("kept"), blank(line)).when(F.col("box").isNotNull(), True).when(F.col("listed"), False).otherwise(clean == ""))
    gap = F.when(is_ascii(clean), clean.rlike(ASCII_GAP)).otherwise(clean.rlike(COLUMN_GAP))
    rows = rows.withColumn("cols", F.when(~F.col("skip") & gap, F.filter(F.transform(F.split(clean, COLUMN_GAP, -1), trim), lambda c: c != "")))
    rows = rows.withColumn("tabular", F.coalesce(F.col("cols").isNotNull() & (F.size("cols") > 1) & ~clean.rlike(r"^[0-9]+\."), F.lit(False)))
    rows = rows.withColumn("number", F.when(looked, numbered(clean)))
    rows = rows.withColumn("quote", looked & clean.rlike(QUOTE)).withColumn("reference", looked & clean.rlike(REFERENCE))
    rows = rows.withColumn("name", F.when(~F.col("skip") & ~F.col("quote"), keyword(clean)))
    rows = rows.withColumn("capital", ~F.col("skip") & F.col("name").isNull() & F.col("number").isNull() & ~F.col("reference") & capitals(clean))
    rows = rows.withColumn("long", (F.length(clean) > LONG) | clean.rlike(SENTENCE))
    # lines with columns are a table if another one stands beside them; pipe rows can be there already
    rows = rows.withColumn("piped", F.col("skip") & F.coalesce(F.col("box"), line).rlike(S.TABLE_ROW))
    w = in_order()
    beside = {"tabular_before": F.lag("tabular", 1, False).over(w), "tabular_ahead": F.lag("tabular", 2, False).over(w), "tabular_after": F.lead("tabular", 1, False).over(w), "piped_before": F.lag("piped", 1, False).over(w)}
    rows = rows.withColumns(beside | {"pipes": F.when(F.col("piped"), F.sum((~F.col("piped")).cast("int")).over(to_here()))})
    rows = rows.withColumn("table", F.col("tabular") & (F.col("tabular_before") | F.col("tabular_after")))
    rows = rows.withColumn("table_before", F.col("tabular_before") & (F.col("tabular_ahead") | F.col("tabular")))
    # numbered lines of one type that only blank and task lines part are a group; with a long one among them they are items
    rows = rows.withColumn("type", F.when(~F.col("skip") & ~F.col("table"), F.col("number.type")))
    rows = rows.withColumn("solid_type", F.when(~F.col("through"), F.coalesce("type", F.lit(""))))
    previous = F.last("solid_type", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("breaks", F.coalesce((F.col("solid_type") != previous) | (F.col("solid_type") == ""), previous.isNull() & F.col("solid_type").isNotNull(), F.lit(False)))
    rows = rows.withColumn("group", F.sum(F.col("breaks").cast("int")).over(to_here()))
    # a numbered line is no pipe row, so groups of the ones and runs of the others are told apart by one column
    rows = rows.withColumn("family", F.when(F.col("type").isNotNull(), F.col("group")).when(F.col("piped"), -1 - F.col("pipes")))
    family = Window.partitionBy("doc_id", "family")
    rows = rows.withColumns({"items": F.max(F.col("long") & F.col("type").isNotNull()).over(family), "n_pipes": F.count("*").over(family), "n_separators": F.count_if(F.col("piped") & line.rlike(S.SEPARATOR_ROW)).over(family)})
    prefix = F.col("number.prefix")
    item = F.concat(F.col("indent"), F.lit("**"), trim_end(prefix), F.lit("**"), F.substring(prefix, F.length(trim_end(prefix)) + 1, F.length(prefix)), F.substring(clean, F.length(prefix) + 1, F.length(clean)))
    row = F.concat(F.lit("| "), F.array_join("cols", " | "), F.lit(" |"))
    title = F.when(F.col("type") == "bracket", F.concat(F.col("indent"), F.lit("**"), clean, F.lit("**"))).otherwise(F.concat(F.col("indent"), F.repeat(F.lit("#"), F.col("number.level")), F.lit(" "), clean))
    forms = [
        (F.col("skip"), F.coalesce(F.col("box"), line), "list"),
        (F.col("name").isNotNull(), F.concat(F.col("indent"), F.lit("## "), F.col("name")), "heading"),
        (F.col("capital"), F.concat(F.col("indent"), F.lit("### "), clean), "heading"),
        (F.col("table"), row, "table"),
        (F.col("type").isNotNull() & ~F.col("items"), title, "heading"),
        (F.col("quote"), F.concat(F.col("indent"), F.regexp_replace(clean, QUOTE, "> **$1**：")), "callout"),
        (F.col("reference"), F.concat(F.col("indent"), F.regexp_replace(clean, REFERENCE, "**$1** ")), "reference"),
        (F.col("type").isNotNull(), linked(item), "item"),
    ]
    new = reduce(lambda c, f: c.when(f[0], f[1]), forms, F).otherwise(linked(line))
    by = reduce(lambda c, f: c.when(f[0], F.lit(f[2])), forms, F).otherwise("link")
    inner = F.regexp_replace(F.regexp_replace(trim(line), "^[|]", ""), r"[|]\z", "")
    n_columns = F.when(F.col("piped") & ~F.col("piped_before") & (F.col("n_pipes") > 1) & (F.col("n_separators") == 0), count(inner, "[|]") + 1)
    started = F.col("table") & ~F.col("table_before") & F.col("name").isNull() & ~F.col("capital")
    n_columns = n_columns.when(started, F.size("cols"))
    rows = rows.withColumn("separator", F.concat(F.lit("|"), F.repeat(F.lit("---|"), n_columns))).withColumn("new", new).withColumn("by", by)
    rows = rows.withColumn("rule", F.when(F.col("new") != line, F.col("by")).otherwise(F.col("rule"))).withColumn("line", F.col("new"))
    return inserted(rows, "table", F.lit(None).cast("string"), F.col("separator"))


def without_gaps(rows: DataFrame) -> DataFrame:
    """Of neighbouring blank lines outside fences the first stays."""
    rows = with_fences(rows).withColumn("gap", ~F.col("in_fence") & blank(F.col("line")))
    rows = rows.withColumn("again", F.col("gap") & F.coalesce(F.lag("gap").over(in_order()), F.lit(False)))
    return relation(rows.where(~F.col("again")))


RULES = (with_code, with_typography, with_titles, with_grids, with_structure, without_gaps)


def stays() -> Column:
    """Texts without a visible line that isn't a page number: formatting would leave nothing of them. Mostly the first lines show it, and
    the others are not looked at."""
    nothing = lambda x: blank(F.regexp_replace(x, f"[{INVISIBLE}]", "")) | S.is_page_number(x)
    none = lambda text: F.forall(F.split(text, "\n", -1), nothing)
    return F.coalesce(F.when(none(F.substring_index("text", "\n", FIRST)), none(F.col("text"))).otherwise(F.col("text").isNull()), F.lit(True))


def formatted_lines(docs: DataFrame) -> DataFrame:
    """The relation after all rules, of the documents that formatting changes."""
    rows = lines(dealt(docs).where(~stays()), state=False).select("doc_id", "line_no", F.lit(0).alias("sub"), "line", F.lit(None).cast("string").alias("rule"))
    rows = rejoined(without_noise(with_fences(rows)))
    return reduce(lambda r, rule: rule(r), RULES, rows)


def formatted(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text): every document formatted. Null and empty texts, and those that no line would be left of, stay. Ids are told
    apart by doc_id, so repeated rows of one id are not for this."""
    place = F.struct("line_no", "sub", "line")
    made = formatted_lines(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda s: s.line), "\n").alias("text"))
    return made.unionByName(docs.where(stays()).select("doc_id", "text"))


def edits(docs: DataFrame) -> DataFrame:
    """The lines that a rule wrote: doc_id, line_no (of the text as it came), sub (0 unless the line was put in), rule, line."""
    return formatted_lines(docs).where("rule IS NOT NULL").select("doc_id", "line_no", "sub", "rule", "line")
