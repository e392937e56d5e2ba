"""Repair of what copying out of chats and word processors breaks: linear formulas, bare environments, diagrams without their fence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, let, trim, trim_start, without_code
from .lines import island, so_far, with_fences
from .repair import repair_inline

# Symbols of linear formulas and their commands.
SYMBOLS = {
    "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint",
    "√": r"\sqrt", "∞": r"\infty", "∂": r"\partial", "∇": r"\nabla",
    "π": r"\pi", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta",
    "Δ": r"\Delta", "ε": r"\epsilon", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu",
    "σ": r"\sigma", "φ": r"\phi", "ω": r"\omega", "Ω": r"\Omega", "Γ": r"\Gamma",
    "≤": r"\le", "≥": r"\ge", "≠": r"\ne", "≈": r"\approx", "≡": r"\equiv",
    "±": r"\pm", "∓": r"\mp", "×": r"\times", "÷": r"\div", "⋅": r"\cdot",
    "∝": r"\propto", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊆": r"\subseteq",
    "∪": r"\cup", "∩": r"\cap", "∅": r"\emptyset", "∀": r"\forall", "∃": r"\exists",
    "→": r"\to", "←": r"\leftarrow", "⇒": r"\Rightarrow", "⇐": r"\Leftarrow",
    "⇔": r"\Leftrightarrow", "∘": r"\circ", "′": "'", "″": "''", "⋯": r"\cdots",
}
# What marks a linear formula, and what a run of text without CJK is.
LINEAR = r"▒|_\(|\^\("
RUN = "[^\u4e00-\u9fff\u3000-\u303f\uff00-\uffef\u201c\u201d\u2018\u2019]+"
# Environments (by how their names begin), and diagram lines.
ENVIRONMENT = r"^\\begin\{((?:aligned|align|cases|pmatrix|bmatrix|vmatrix|matrix|array|gathered|split|Bmatrix|Vmatrix|smallmatrix)[a-zA-Z*]*)\}"
DIAGRAM = r"(?i)^(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|mindmap|journey|gitGraph|requirementDiagram)([^a-zA-Z0-9_]|\z)"
ARROW = r"-->|-\.->|==>|->>|-{3,}|─{2,}>"
NO_DIAGRAM = r"^([|#]|[0-9]+\.[ \t]|[-*+][ \t])"


def latex(x: Column) -> Column:
    """Linear notation as LaTeX: bracketed scripts get braces, to a nesting of two, and symbols their commands."""
    x = F.replace(x, F.lit("▒"), F.lit(" "))
    for _ in range(2):
        x = F.regexp_replace(F.regexp_replace(x, r"_\(([^()]*)\)", r"_{$1}"), r"\^\(([^()]*)\)", r"^{$1}")
    names = F.create_map(*(F.lit(y) for pair in SYMBOLS.items() for y in pair))
    # a command in front of a letter needs a blank
    gap = lambda c, name, i: F.when(name.rlike("[a-zA-Z]$") & F.coalesce(F.get(c, i + 1), F.lit("")).rlike("^[a-zA-Z]"), " ").otherwise("")
    spelled = lambda c: F.transform(c, lambda s, i: F.coalesce(F.concat(F.try_element_at(names, s), gap(c, F.try_element_at(names, s), i)), s))
    return F.array_join(let(F.split(x, "", -1), spelled), "")


def without_formulas(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(without_code(x), r"[$][$][^$]*[$][$]", ""), r"[$][^$\n]+[$]", "")


def in_text(docs: DataFrame) -> DataFrame:
    """Lines with ``active``: outside fences and formula blocks."""
    rows = repair_inline(docs)
    inside = (F.sum("delims").over(so_far()) % 2 == 1) & (F.col("delims") == 0)
    return rows.select("doc_id", "line_no", "line", (~F.col("in_fence") & ~inside).alias("active"))


def linear_formulas(docs: DataFrame) -> DataFrame:
    """Lines with a linear formula and what they become: doc_id, line_no, line, fixed. A line without CJK becomes a formula as a whole,
    in others each run without CJK that has the marks does. Without ``line`` and ``fixed`` this is the report of a dry run."""
    rows = in_text(docs).where(F.col("active") & F.col("line").rlike(LINEAR)).withColumn("bare", without_formulas(F.col("line"))).where(F.col("bare").rlike(LINEAR))
    return rows.select("doc_id", "line_no", "line", as_formulas().alias("fixed")).where("fixed <> line")


def as_formulas() -> Column:
    """A row's line with its linear formulas as LaTeX; ``bare`` is the line without code and formulas."""
    whole = let(trim(latex(F.col("bare"))), lambda t: F.when(t == "", F.col("line")).when(t.startswith("$$"), t).otherwise(F.concat(F.lit("$$"), t, F.lit("$$"))))
    parts = F.arrays_zip(F.split("line", RUN, -1).alias("outside"), F.regexp_extract_all("line", F.lit(f"({RUN})"), F.lit(1)).alias("run"))
    formula = lambda run: let(trim(latex(run)), lambda t: F.when(t == "", run).otherwise(F.concat(F.lit("$"), t, F.lit("$"))))
    run = lambda p: F.when(p.run.rlike(LINEAR), formula(p.run)).otherwise(F.coalesce(p.run, F.lit("")))
    mixed = F.array_join(F.transform(parts, lambda p: F.concat(p.outside, run(p))), "")
    return F.when(F.col("line").rlike("[\u4e00-\u9fff]"), mixed).otherwise(whole)


def bare_environments(docs: DataFrame) -> DataFrame:
    """Environments outside formulas, which need $$ lines around them: doc_id, first_line, last_line, name.

    One reaches to the first line that ends its name. Those that already stand between $$ lines stay, as do those that never end. An
    environment that starts within another of the same document belongs to that.
    """
    return environments(in_text(docs))


def environments(rows: DataFrame) -> DataFrame:
    """The same of rows (doc_id, line_no, line, active)."""
    found = marked_environments(rows.select("doc_id", "line_no", "line", "active")).where("last_line IS NOT NULL")
    return found.select("doc_id", F.col("line_no").alias("first_line"), "last_line", "name")


def marked_environments(rows: DataFrame) -> DataFrame:
    """Adds name and last_line to rows (doc_id, line_no, line, active): of the bare environment that starts with a line, else null.

    Everything is windows over a document's lines in their order, so the rows are neither read again nor joined nor exchanged. Only
    lines that start an environment keep the list of the document's ends, for one step."""
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("before", F.lag("line").over(doc)).withColumn("after", F.lead("line").over(doc))
    name = F.when(F.col("active") & F.col("line").contains("\\begin{"), F.regexp_extract(trim(F.col("line")), ENVIRONMENT, 1))
    closed = F.array_distinct(F.regexp_extract_all("line", F.lit(r"\\end\{([a-zA-Z*]+)\}"), F.lit(1)))
    own = F.transform(closed, lambda x: F.struct(F.col("line_no"), x.alias("name"), (F.coalesce(trim(F.col("after")), F.lit("")) == "$$").alias("closed")))
    rows = rows.withColumn("name", F.when(name != "", name)).withColumn("ends", F.when(F.col("line").contains("\\end{"), own))
    rows = rows.withColumn("ends", F.collect_list("ends").over(Window.partitionBy("doc_id")))
    first = F.array_min(F.filter(F.flatten("ends"), lambda e: (e.line_no >= F.col("line_no")) & (e["name"] == F.col("name"))))
    rows = rows.withColumn("end", F.when(F.col("name").isNotNull(), first)).drop("ends")
    closed = (F.coalesce(trim(F.col("before")), F.lit("")) == "$$") & F.col("end.closed")
    rows = rows.withColumn("last_line", F.when(~closed, F.col("end.line_no")))
    reach = F.max("last_line").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("last_line", F.when(F.coalesce(reach < F.col("line_no"), F.lit(True)), F.col("last_line")))
    return rows.drop("before", "after", "end")


def diagrams(rows: DataFrame) -> DataFrame:
    """Runs of diagram lines without a fence: doc_id, first_line, last_line. rows: doc_id, line_no, line.

    A run of neighbouring lines with a diagram's name or an arrow counts from its first line if it has three lines or more, two of them
    with arrows; otherwise from its first line with a name that another follows. (What is left of a run never has more lines or arrows
    than the run, so no later start can do for the first reason.)
    """
    head, arrow = trim(F.col("line")).rlike(DIAGRAM), F.col("line").rlike(ARROW)
    rows = with_fences(rows, "ticks_or_tildes").withColumn("head", head).withColumn("arrow", arrow)
    rows = rows.withColumn("drawn", ~F.col("in_fence") & ~trim_start(F.col("line")).rlike(NO_DIAGRAM) & (F.col("head") | F.col("arrow")))
    runs = rows.withColumn("run", island(F.col("drawn"))).where("drawn").groupBy("doc_id", "run").agg(
        F.min("line_no").alias("start"), F.max("line_no").alias("last_line"), F.count_if("arrow").alias("arrows"), F.min(F.when(F.col("head"), F.col("line_no"))).alias("named")
    )
    whole = (F.col("last_line") - F.col("start") >= 2) & (F.col("arrows") >= 2)
    first = F.when(whole, F.col("start")).when(F.col("named") < F.col("last_line"), F.col("named"))
    return runs.select("doc_id", first.alias("first_line"), "last_line").where("first_line IS NOT NULL")


def academic(rows: DataFrame) -> DataFrame:
    """Class and number of each block of an academic paper: doc_id, line_no, class, number. rows: doc_id, line_no, line; a block is a
    line that isn't empty.

    The first h1 is the title; an h2 right behind a title that opens the paper is its subtitle; from the h2 of the references on,
    paragraphs and lists are references. Levels 2 to 4 are numbered, without subtitle and references.
    """
    rows = rows.where(trim(F.col("line")) != "")
    level = F.length(F.regexp_extract("line", "^(#{1,4}) ", 1))
    tag = F.when(level > 0, F.concat(F.lit("h"), level.cast("string"))).when(F.col("line").rlike("^([-*+]|[0-9]+\\.) "), "list").otherwise("p")
    text = trim(F.regexp_replace("line", "^(#{1,4}|[-*+]|[0-9]+\\.) ", ""))
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.select("doc_id", "line_no", tag.alias("tag"), text.alias("text"), level.alias("level"))
    reference = (F.col("tag") == "h2") & F.col("text").contains("参考文献")
    rows = rows.select("*", F.row_number().over(doc).alias("place"), F.count_if(F.col("tag") == "h1").over(doc).alias("titles"), reference.alias("reference"), F.max(reference).over(doc).alias("in_references"))
    in_references = F.col("in_references")
    starts = lambda *words: F.col("text").rlike(f"^({'|'.join(words)})")
    name = (
        F.when((F.col("tag") == "h1") & (F.col("titles") == 1), "title")
        .when(F.col("reference"), "ref-title")
        .when((F.col("tag") == "h2") & (F.col("place") == 2) & (F.col("titles") == 1), "subtitle")
        .when(F.col("tag").isin("p") & in_references, "ref-item")
        .when((F.col("tag") == "list") & in_references, "ref-list")
        .when((F.col("tag") == "p") & (starts("摘要", "关键词") | F.col("text").rlike(r"\*\*(摘要|关键词)\*\*")), "abstract")
        .when((F.col("tag") == "p") & starts("副标题：", "副标题:", "——"), "subtitle-p")
        .when(F.col("tag") == "p", "p")
        .otherwise("")
    )
    rows = rows.withColumn("class", name)
    deep = F.when((F.col("level") >= 2) & ~F.col("class").isin("subtitle", "ref-title"), F.col("level") - 1)
    rows = rows.withColumn("deep", deep)
    of = lambda n, *keys: F.count_if(F.col("deep") == n).over(Window.partitionBy("doc_id", *keys).orderBy("line_no"))
    rows = rows.withColumn("n1", of(1)).withColumn("n2", of(2, "n1")).withColumn("n3", of(3, "n1", "n2"))
    number = F.when(F.col("deep").isNotNull(), F.array_join(F.slice(F.array("n1", "n2", "n3"), F.lit(1), F.coalesce("deep", F.lit(1))), "."))
    return rows.select("doc_id", "line_no", "class", number.alias("number"))


# Characters that end a naked link, those that may not precede it, and punctuation that is not part of its end.
_URL = f"[^{WS}<>\"'一-龥，。；：！？）】》」』、…—–·]"
NAKED = rf"""(?<![(<"'\[=\\])(?:https?://{_URL}+|www\.{_URL}+)"""
TAIL = "[.,;:!?)\\]}>'\"’”」』】〉，。；：！？、…]*\\z"


def naked_links(rows: DataFrame) -> DataFrame:
    """Naked links of lines: doc_id, line_no, n, bare, href, rest. Punctuation behind a link isn't part of it, unless it is a bracket that
    the link itself opens. rows: doc_id, line_no, line."""
    found = rows.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(f"({NAKED})"), F.lit(1))).alias("n", "url"))
    found = found.withColumn("core", F.length("url") - F.length(F.regexp_extract("url", f"({TAIL})", 1)))
    head = lambda i: F.substring(F.col("url"), F.lit(1), i)
    opened = lambda i: (F.substring(F.col("url"), i, F.lit(1)) == ")") & (F.regexp_count(head(i), F.lit("[(]")) >= F.regexp_count(head(i), F.lit("[)]")))
    kept = F.array_max(F.filter(F.sequence(F.col("core"), F.length("url")), lambda i: (i == F.col("core")) | ((i > F.col("core")) & opened(i))))
    found = found.withColumn("kept", kept)
    bare = head(F.col("kept"))
    return found.select("doc_id", "line_no", "n", bare.alias("bare"), F.when(bare.startswith("www."), F.concat(F.lit("https://"), bare)).otherwise(bare).alias("href"), F.expr("substring(url, kept + 1)").alias("rest"))
