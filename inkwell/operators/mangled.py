"""Repair of formulas that were pasted two or three times: copying a rendered formula takes its visible text and its source along.

A formula's characters are mapped to what their commands are called and stripped of what only layout needs; the places where it may be
cut are places in the mapped text. The stripped text alone tells how much of it a first piece can have, which leaves few first cuts; cutting
into pieces of equal mapped length leaves at most three places for a second one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, is_ascii, trim

# Symbols of rendered formulas and what they are called in sources.
NAMES = {
    "−": "-", "–": "-", "—": "-", "―": "-", "‒": "-",
    "×": "times", "⋅": "cdot", "·": "cdot", "∗": "star", "⋆": "star",
    "≈": "approx", "≅": "cong", "≃": "simeq", "≠": "neq",
    "≤": "leq", "≥": "geq", "±": "pm", "∓": "mp",
    "→": "rightarrow", "←": "leftarrow", "⇒": "Rightarrow", "⇔": "Leftrightarrow",
    "∑": "sum", "∏": "prod", "∫": "int", "√": "sqrt", "∂": "partial", "∇": "nabla",
    "∈": "in", "∖": "backslash", "∞": "infty", "ℓ": "ell",
    "⟨": "langle", "⟩": "rangle", "°": "circ", "…": "ldots", "⋯": "cdots",
    "⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁻": "-",
    "₀": "0", "₁": "1", "₂": "2", "₃": "3", "₄": "4", "₅": "5", "₆": "6", "₇": "7", "₈": "8", "₉": "9",
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ϵ": "epsilon", "ζ": "zeta", "η": "eta",
    "θ": "theta", "ϑ": "vartheta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi",
    "π": "pi", "ρ": "rho", "ϱ": "varrho", "σ": "sigma", "ς": "varsigma", "τ": "tau", "υ": "upsilon",
    "φ": "phi", "ϕ": "varphi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Υ": "Upsilon",
    "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega",
}
# Lengths of formulas that are looked at, of the stripped text, and of a piece.
LEAST, MOST, LEAST_KEY, PIECE = 6, 1200, 12, 4
LAYOUT = f"[{WS}\\\\_^{{}}]"
#: A character that isn't ASCII.
BEYOND = r"[^\x00-\x7f]"
COMMAND, SCRIPT = r"\\[a-zA-Z]+", "[_^]"


def name(c: Column) -> Column:
    """What one character is called; null if it has no name. It is looked up by its place in the string of all: replacing all names, one
    after the other, in each formula was much of the work."""
    return F.get(F.array(*map(F.lit, NAMES.values())), F.instr(F.lit("".join(NAMES)), c) - 1)


def spelled(x: Column, plain: Callable[[Column], Column], special: Callable[[Column], Column]) -> Column:
    """A text whose stretches of ASCII and whose other characters, one by one, are written anew; no character with a name is ASCII."""
    parts, found = F.split(x, BEYOND, -1), F.regexp_extract_all(x, F.lit(BEYOND), F.lit(0))
    both = F.zip_with(F.transform(parts, plain), F.transform(found, special), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(is_ascii(x), plain(x)).otherwise(F.array_join(both, ""))


def named(x: Column) -> Column:
    """Characters under the names of their commands."""
    return spelled(x, lambda part: part, lambda c: F.coalesce(name(c), c))


def starts(x: Column) -> Column:
    """A text as long as named(): 1 where a character starts, 0 behind that."""
    return spelled(x, lambda part: F.repeat(F.lit("1"), F.length(part)), lambda c: F.rpad(F.lit("1"), widths(c).p, F.lit("0")))


def bare(x: Column) -> Column:
    """A text of named() without what only layout needs."""
    return F.regexp_replace(x, LAYOUT, "")


def compare_key(x: Column) -> Column:
    """What two copies of a formula have in common, rendered or as source."""
    return bare(named(x))


def latex_score(x: Column) -> Column:
    """How much a text looks like a formula's source: 0, 2 or 4."""
    return F.when(x.rlike(COMMAND), 2).otherwise(0) + F.when(x.rlike(SCRIPT), 2).otherwise(0)


def widths(c: Column) -> Column:
    """How long one character is as named(), p, and as compare_key(), q."""
    size = F.length(name(c))
    return F.struct(F.coalesce(size, F.lit(1)).alias("p"), F.coalesce(size, F.when(c.rlike(LAYOUT), 0).otherwise(1)).alias("q"))


def sums(sizes: Column) -> Column:
    """The running sums of an array but for the last."""
    more = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    return F.aggregate(sizes, F.array().cast("array<int>"), more, lambda acc: F.slice(acc, 1, F.size(acc) - 1))


def best(pieces: list[Column]) -> Column:
    """The first of the pieces with the highest score."""
    scores = [latex_score(p) for p in pieces]
    first = F
    for k, p in enumerate(pieces[:-1]):
        wins = reduce(lambda a, b: a & b, [scores[k] > s for s in scores[:k]] + [scores[k] >= s for s in scores[k + 1 :]], F.lit(True))
        first = first.when(wins, p)
    return first.otherwise(pieces[-1])


def repaired(formulas: DataFrame, column: str = "formula") -> DataFrame:
    """Adds ``repaired``: the formula's best copy if it consists of three pieces, two of them equal, or of two equal pieces; otherwise the
    formula as it is. Pieces are equal if their mapped texts have one length and their keys agree.

    The first cuts in order where exactly two pieces are equal count; of them the third, if it looks like a source and its key isn't
    shorter, or else the piece with the highest score stays. Then three equal pieces, then two. Formulas under 6 or over 1200 characters, or
    with a key under 12, stay; null stays null. Characters are code points.
    """
    raw = F.col(column)
    looked = formulas.select(F.struct("*").alias("row"), raw.alias("raw")).withColumn("m", F.when(F.length("raw").between(LEAST, MOST), named(F.col("raw"))))
    looked = looked.withColumn("key", bare(F.col("m"))).withColumn("key", F.when(F.length("key") >= LEAST_KEY, F.col("key")))
    # where characters start in the mapped text, and how much of the key stands before each character of layout
    looked = looked.withColumn("starts", F.when(F.col("key").isNotNull(), starts(F.col("raw")))).withColumn("layout", F.when(F.col("key").isNotNull(), sums(F.transform(F.split("m", LAYOUT, -1), F.length))))
    looked = looked.withColumn("n", F.length("raw")).withColumn("total", F.length("m")).withColumn("size", F.length("key"))
    n, total, size, key = F.col("n"), F.col("total"), F.col("size"), F.col("key")

    def could_end(q: Column) -> Column:
        """Whether a first piece can have a key of this length: by the keys alone, the first two, the outer two or the last two agree."""
        half, first = F.shiftright(size - q, 1), key.substr(F.lit(1), q)
        return ((q * 2 <= size) & (key.endswith(first) | (key.substr(q + 1, q) == first))) | ((half * 2 == size - q) & key.endswith(key.substr(q + 1, half)))

    def places(q: Column) -> Column:
        """The cuts, in the mapped text, with a key of this length before them: layout may stand on either side."""
        return F.sequence(q + F.size(F.filter("layout", lambda k: k < q)), q + F.size(F.filter("layout", lambda k: k <= q)))

    def at(x: Column) -> Column:
        """How many characters of the formula stand before a cut of the mapped text."""
        return F.length(F.replace(F.substring("starts", F.lit(1), x), F.lit("0"), F.lit("")))

    def is_cut(x: Column) -> Column:
        return F.substring("starts", x + 1, F.lit(1)) != "0"

    def key_between(x: Column, y: Column) -> Column:
        return bare(F.substring("m", x + 1, y - x))

    def cuts(x: Column) -> Column:
        # the second cut where the first two, the outer two or the last two pieces have one mapped length
        seconds = F.array_distinct(F.array(x * 2, total - x, F.when((total + x) % 2 == 0, (total + x) / 2).cast("int")))
        fits = lambda i: F.filter(seconds, lambda y: is_cut(y) & at(y).between(i + PIECE, n - PIECE))
        cut = lambda i, y: F.struct(x.alias("x"), y.alias("y"), i.alias("i"), at(y).alias("j"), odd(x, y).alias("odd"))
        return F.flatten(F.transform(F.array(at(x)), lambda i: F.transform(fits(i), lambda y: cut(i, y))))

    def odd(x: Column, y: Column) -> Column:
        """The place of the piece that isn't one of the two equal ones; -1 if all are equal, null if none are."""
        first, second, third = key_between(F.lit(0), x), key_between(x, y), key_between(y, total)
        e12, e13, e23 = (x * 2 == y) & (first == second), (total - y == x) & (first == third), (y - x == total - y) & (second == third)
        return F.when(e12 & e13, -1).when(e12, 2).when(e13, 1).when(e23, 0)

    # an empty key ends everywhere in a stretch of layout, so the ends of the key count always, and their places are mostly too near an end
    firsts = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), size), could_end), places))
    firsts = F.filter(firsts, lambda x: x.between(PIECE, total - 2 * PIECE) & is_cut(x) & at(x).between(PIECE, n - 2 * PIECE))
    looked = looked.withColumn("firsts", F.when(n >= 3 * PIECE, firsts)).withColumn("cuts", F.filter(F.flatten(F.transform("firsts", cuts)), lambda c: c.odd.isNotNull()))
    three = F.coalesce(F.array_min(F.filter("cuts", lambda c: c.odd >= 0)), F.array_max("cuts"))
    looked = looked.withColumn("three", three).withColumn("half", F.when(F.col("three").isNull() & (total % 2 == 0), total / 2).cast("int"))
    piece = lambda i, j: F.col("raw").substr(i + 1, j - i)
    ends = [F.lit(0), F.col("three.i"), F.col("three.j"), n]
    pieces = [piece(i, j) for i, j in zip(ends, ends[1:], strict=False)]
    ends = [F.lit(0), F.col("three.x"), F.col("three.y"), total]
    keys = [key_between(x, y) for x, y in zip(ends, ends[1:], strict=False)]
    kept = F
    for k, p in enumerate(pieces):
        source = (p.rlike(COMMAND) | p.rlike(SCRIPT)) & (F.length(keys[k]) >= F.length(keys[1 if k == 0 else 0]))
        kept = kept.when((F.col("three.odd") == k) & source, p)
    kept = kept.when(F.col("three").isNotNull(), best(pieces))
    half = F.col("half")
    two = is_cut(half) & at(half).between(PIECE, n - PIECE) & (key_between(F.lit(0), half) == key_between(half, total))
    kept = trim(kept.when(two, best([piece(F.lit(0), at(half)), piece(at(half), n)])))
    return looked.withColumn("repaired", F.coalesce(kept, F.col("raw"))).select("row.*", "repaired")


def mangled(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, kind, formula): a document's formula as pages that render it leave it in the clipboard; the kind says how often."""
    # of the text only as much is looked at as the word needs, and once, not for every formula
    head = F.regexp_extract("text", "^(?:[ \\n\\t.,]*[^ \\n\\t.,]){0,9}", 0)
    docs = docs.select("doc_id", F.translate(head, " \n\t.,", "").alias("word"), F.col("n_chars").cast("string").alias("n"))
    word, n = F.col("word"), F.col("n")
    docs = docs.select("doc_id", F.concat(F.lit(r"\kappa_{"), word, F.lit(r"}\leq "), n, F.lit("^{2}")).alias("source"), F.concat(F.lit("κ"), word, F.lit("≤"), n, F.lit("2")).alias("shown"))
    source, shown = F.col("source"), F.col("shown")
    ways = [[shown, source, shown], [source, source], [source, source, source], [shown, shown, source], [source], [source, shown, shown], [shown, F.lit("  "), shown], [shown, source]]
    rows = docs.select("doc_id", F.posexplode(F.array(*(F.concat(*w) for w in ways))).alias("kind", "formula"))
    return rows.withColumn("kind", F.col("kind").cast("long"))


def mangled_formulas(docs: DataFrame) -> DataFrame:
    """The repair of every document's copies: doc_id, kind, formula, key, score, repaired."""
    rows = repaired(mangled(docs))
    return rows.select("doc_id", "kind", "formula", compare_key(F.col("formula")).alias("key"), latex_score(F.col("formula")).cast("long").alias("score"), "repaired")
