"""Operator 11: periodic runs of words (Kolpakov and Kucherov, 1999).

A run is a stretch of consecutive words with a smallest period of at most half its length that no neighbouring word extends. The words
are cut into factors, each the longest piece that occurs before (read off a suffix automaton). A run that starts before a factor, or at
its start, and ends in it lies close to the factor's start and is found there from the longest extensions to both sides (Main, 1989). A
run inside a factor is a copy of one inside the factor's earlier occurrence and is copied from there.

Runs shorter than MIN_LENGTH words don't count. Every word of a run that counts lies in a window of half that length which occurs twice
within the run; so stretches covered by repeated windows are looked for first, and only these go through the factorisation.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import let
from .common import table

#: Least length of a run in words; a run has two periods at least besides.
MIN_LENGTH = 12

Run = tuple[int, int, int]


def repeated(w: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` numbers that occur more than once (by a 64-bit hash: too many at worst)."""
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.flatnonzero(np.isin(h, twice)) if len(twice) else twice.astype(np.int64)


def stretches(w: np.ndarray, least: int = MIN_LENGTH) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) of w that hold all its runs of ``least`` or more, each whole.

    A run of period q has the same window of least / 2 words at i and at i + q for every i up to length - q - least / 2, and these cover
    it; a stretch is looked through again on its own until that takes little away."""
    size, open_ = least // 2, [(0, len(w))]
    while open_:
        start, end = open_.pop()
        if end - start < least:
            continue
        at = repeated(w[start:end], size)
        edges = np.zeros(end - start + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        turn = np.flatnonzero(np.diff(np.r_[0, np.cumsum(edges)[:-1] > 0, 0]))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if 10 * (b - a) >= 9 * (end - start):
                yield start + a, start + b
            else:
                open_.append((start + a, start + b))


def factors(w: list[int]) -> list[Run]:
    """(start, length, start of an earlier occurrence or -1) of the factors: the longest piece that also starts before, or one new word."""
    after: list[dict[int, int]] = [{}]
    link, size, first, last = [-1], [0], [-1], 0
    for i, c in enumerate(w):
        new = len(after)
        after.append({})
        link.append(0)
        size.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                split = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    out, at, n = [], 0, len(w)
    while at < n:
        state = k = 0
        # a state's pieces all end first at first[state]
        while at + k < n and (to := after[state].get(w[at + k])) is not None and first[to] - k < at:
            state, k = to, k + 1
        out.append((at, k, first[state] - k + 1) if k else (at, 1, -1))
        at += k or 1
    return out


def extensions(w: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of w and what starts there."""
    n = len(w)
    z, left, right = [n] * n, 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and w[k] == w[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def crossing(w: list[int], low: int, border: int, high: int, least: int) -> Iterator[Run]:
    """Runs (start, end, period) of ``least`` or more that touch the border and lie in w[low:high]; a period may be a multiple of the
    smallest one, which is then among them for the same stretch."""
    t, u = w[low:border], w[border:high]
    back, nt, nu = t[::-1], len(t), len(u)
    ahead, behind = extensions(u), extensions(back)
    # common suffixes of t and t + u[:p]; common prefixes of u and t[-p:] + u
    before = extensions([*back, -1, *u[::-1], *back])[nt + 1 : nt + 1 + nu]
    beyond = extensions([*u, -1, *t, *u])[nu + 1 : nu + 1 + nt]
    found = []
    for p in range(1, nu + 1):
        left, right = before[nu - p], ahead[p] if p < nu else 0
        if left + right >= p and left + right + p >= least:
            found.append((border - left, border + p + right, p))
    for p in range(1, nt + 1):
        left, right = behind[p] if p < nt else 0, beyond[nt - p]
        if left + right >= p and left + right + p >= least:
            found.append((border - p - left, border + right, p))
    for start, end, p in found:
        if (start == 0 or w[start - 1] != w[start - 1 + p]) and (end == len(w) or w[end] != w[end - p]):
            yield start, end, p


def runs(w: list[int], least: int = MIN_LENGTH) -> list[Run]:
    """All runs (start, end, smallest period) of ``least`` words or more, by start, then period."""
    period: dict[tuple[int, int], int] = {}
    starts: list[int] = []
    ends: dict[int, list[int]] = {}

    def keep(start: int, end: int, p: int) -> None:
        if (start, end) not in period:
            period[start, end] = p
            if start not in ends:
                insort(starts, start)
            ends.setdefault(start, []).append(end)
        elif p < period[start, end]:
            period[start, end] = p

    before = 0
    for at, size, earlier in [*factors(w), (len(w), 0, -1)]:
        # a run that ends in this factor starts at most so far before it, else the factor before would be longer
        reach = size + 2 * before
        if min(reach, at) + size >= least:
            for run in crossing(w, max(0, at - reach), at, at + size, least):
                keep(*run)
        i = bisect_right(starts, earlier)
        while earlier >= 0 and i < len(starts) and starts[i] < earlier + size:
            start, i = starts[i], i + 1
            for end in ends[start]:
                if end < earlier + size:
                    keep(start - earlier + at, end - earlier + at, period[start, end])
        before = size
    return sorted(((s, e, p) for (s, e), p in period.items()), key=lambda r: (r[0], r[2]))


def runs_of_words(words: list[bytes], least: int = MIN_LENGTH) -> list[Run]:
    """The runs of a text's words; words are told apart exactly, by their place in a dictionary of the text."""
    if len(words) < least:
        return []
    ids = dict(zip(words, range(len(words)), strict=True))
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    found = [(a + s, a + e, p) for a, b in stretches(w, least) for s, e, p in runs(w[a:b].tolist(), least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """One row per document: the id, n_words, runs (array of start, length, period, by start, then period) and collapsed: the words
    without those that a run holds after its first period, joined by one space.

    Words are maximal runs of characters other than ASCII blanks, numbered from 0. ``least`` is the shortest run that counts, 2 or
    more. Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows and null ids are rows like any
    other; an empty table gives none; other columns are left out. A text is read whole by one task, in memory that grows with
    its words, and about 1 kB a word for the largest of its stretches with repeated windows; no row leaves its task.
    """
    if least < 2:
        raise ValueError("runs have two words at least")
    kept = docs.select(id_col, text_col)
    of_runs = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))
    schema = kept.select(id_col).schema.add("n_words", "long").add("runs", of_runs).add("collapsed", "string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").split()
                own = runs_of_words(words, least)
                counts.append(len(words))
                found.append([{"start": s, "length": e - s, "period": p} for s, e, p in own])
                if own:
                    stays = np.ones(len(words), bool)
                    for s, e, p in own:
                        stays[s + p : e] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def seeded(text: Column, id_col: Column) -> Column:
    """The contract's input: of a tenth of the documents (by the crc32 of the id) the words from a place on repeat with a period."""
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        start = F.pmod(g, n)
        period = F.lit(1) + F.floor((n - start) / (3 + g % 8))
        place = lambda i: F.when(i >= start, start + (i - start) % period).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")).otherwise("")

    return F.when(h % 10 == 0, let(words, repeat)).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", seeded(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    found = periodic_runs(docs).select("*", best.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
