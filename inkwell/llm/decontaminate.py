"""Operator 8: benchmark decontamination with a positional inverted index.

Training documents are indexed once, in segments (blocks of whole documents): for each term of the tests the sorted token positions at
which it occurs. The index is stored. Tests stay on Spark too: each window is looked up in the segments that hold its rarest term (by the
index's counts over all segments), where that term's positions, less its offset, are candidate starts, which are intersected with the
offset-adjusted positions of the next rarest term and so on. A segment holds all postings of its documents, so no list grows
beyond its segment; a segment takes its windows one batch after the other.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, stored, table

WINDOW = 13
#: A segment is closed at this many tokens (a longer document has one of its own).
SEGMENT_TOKENS = 200_000
#: Proximity: an item's rarest terms, all within SPAN words of an occurrence of the rarest of them.
RARE_TERMS, SPAN = 4, 40
#: The index is restricted to the tests' terms if these are not more (8 bytes each are sent to tasks), and holds all terms otherwise.
SENT_TERMS = 2_000_000
#: Documents in a segment lie this far apart, so that no phrase and no proximity match reaches from one into the next.
APART = 64

#: A-Z to a-z, other ASCII than letters and digits to a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

INDEX = "segment long, keys array<long>, ids array<long>, n_words array<long>, starts array<long>, terms array<long>, bounds array<long>, postings array<int>"
FOUND = "key long, id long, n_words long, n_hit long, windows array<long>, near array<long>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def words_of(text: Column) -> Column:
    """The same of a column."""
    return F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), GAP, -1), lambda w: w != "")


def build_index(docs: DataFrame, terms: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``terms`` (hashes, sorted; None: of all terms): one row per segment with its documents' row keys, ids, word counts
    and first positions, the terms found, and their postings one after the other, ``bounds`` between them."""
    sent = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, SEGMENT_TOKENS
        keys, ids, counts, starts, parts, at = [], [], [], [], [], 0
        row = number

        def segment() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            if sent is None:
                places = np.concatenate([np.arange(len(p)) + s for p, s in zip(parts, starts, strict=True)])
            else:
                known = sent.value
                there = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                mine = known[there] == tokens if len(known) else np.zeros(len(tokens), bool)
                places = np.concatenate([np.arange(len(p)) + s for p, s in zip(parts, starts, strict=True)])[mine]
                tokens = tokens[mine]
            order = np.argsort(tokens, kind="stable")
            found, first = np.unique(tokens[order], return_index=True)
            values = [number, keys, ids, counts, starts, found.view(np.int64), [*first.tolist(), len(order)], places[order].astype(np.int32)]
            types = [pa.int64(), *[pa.list_(pa.int64())] * 6, pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["segment", "keys", "ids", "n_words", "starts", "terms", "bounds", "postings"])

        for batch in batches:
            for doc, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                w = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in words(text)), np.uint64)
                keys.append(row)
                row += 1
                ids.append(doc)
                counts.append(len(w))
                starts.append(at)
                parts.append(w)
                at += len(w) + APART
                if at >= size:
                    yield segment()
                    keys, ids, counts, starts, parts, at, number = [], [], [], [], [], 0, number + 1
        if ids:
            yield segment()

    return stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX), "postings")


def lookups(items: DataFrame, index: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(segment, window, terms) of what is to be looked up where: ``terms`` are a window's in order, or, with ``near``, an item's rarest; and the
    names (window, name) of the items that a window, or an item's own number, stands for. items: name, w (words)."""
    frequency = index.select(F.explode(F.arrays_zip("terms", F.transform("terms", lambda t, i: F.get("bounds", i + 1) - F.get("bounds", i)).alias("n"))).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.n").alias("n"))
    frequency = stored(frequency, "term-counts")
    last = F.greatest(F.size("w") - window, F.lit(0))
    phrases = items.select("name", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, F.lit(window)))).alias("p"))
    phrases = stored(phrases.select("name", "p", F.xxhash64(F.array_join("p", " ")).alias("window")), "windows")
    whole = phrases.groupBy("window").agg(F.first("p").alias("p"))
    whole = whole.select("window", F.lit(False).alias("near"), "p", F.transform("p", lambda x: F.xxhash64(x)).alias("terms"))
    alone = items.select(F.xxhash64("name", F.array_join("w", " ")).alias("window"), F.lit(True).alias("near"), F.array_distinct("w").alias("p"))

    def ranked(rows: DataFrame) -> DataFrame:
        """With ``order``: up to RARE_TERMS of the words from the rarest on (ties: by text), as hashes; rows with a word that no document has go."""
        each = rows.select("window", F.explode("p").alias("word")).distinct().select("*", F.xxhash64("word").alias("term")).join(frequency, "term", "left")
        best = each.groupBy("window").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "term"))), 1, RARE_TERMS).alias("r"))
        return best.where(F.col("r")[0].n > 0).select("window", F.transform("r", lambda x: x.term).alias("order"))

    exact = whole.join(ranked(whole), "window").select("window", "near", "terms", F.col("order")[0].alias("term"))
    close = ranked(alone).select("window", F.lit(True).alias("near"), F.col("order").alias("terms"), F.col("order")[0].alias("term"))
    wanted = stored(exact.unionByName(close), "lookups")
    where = index.select("segment", F.explode("terms").alias("term"))
    names = phrases.select("window", "name").distinct()
    return where.join(wanted, "term").select("segment", "near", "window", "terms"), names


def match(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per indexed document: key, id, n_words, n_hit (words inside windows), windows found in it, and items near in it."""

    def starts_of(lists: list[np.ndarray]) -> np.ndarray:
        """Starts of a phrase from its terms' positions, the shortest list first."""
        out = None
        for k in sorted(range(len(lists)), key=lambda k: len(lists[k])):
            adjusted = lists[k] - k
            out = adjusted if out is None else out[adjusted[np.minimum(np.searchsorted(adjusted, out), len(adjusted) - 1)] == out]
            if not len(out):
                break
        return out

    def close_to(lists: list[np.ndarray]) -> np.ndarray:
        """Positions of the first term that have all others within SPAN words."""
        here = lists[0]
        for other in lists[1:]:
            here = here[np.searchsorted(other, here + SPAN, "right") > np.searchsorted(other, here - SPAN, "left")]
        return here

    class Segment:
        def __init__(self, batch: pa.RecordBatch, i: int):
            self.keys, self.ids, self.n_words, self.starts, self.terms, self.bounds, self.postings = (batch.column(k)[i].values for k in range(4, 11))
            self.starts, self.terms, self.bounds, self.postings = (x.to_numpy(zero_copy_only=False) for x in (self.starts, self.terms.view(pa.uint64()), self.bounds, self.postings))
            total = int(self.starts[-1]) + self.n_words[-1].as_py()
            self.edge = np.zeros(total + 1, np.int32)
            self.found: list[list[set[int]]] = [[set() for _ in self.keys] for _ in range(2)]

        def look_up(self, windows: list[int], near: list[bool], offsets: np.ndarray, terms: np.ndarray) -> None:
            at = np.searchsorted(self.terms, terms)
            there = self.terms[np.minimum(at, len(self.terms) - 1)] == terms
            whole = np.flatnonzero(np.logical_and.reduceat(there, offsets[:-1]))
            for k in whole.tolist():
                lists = [self.postings[self.bounds[t] : self.bounds[t + 1]] for t in at[offsets[k] : offsets[k + 1]].tolist()]
                hits = close_to(lists) if near[k] else starts_of(lists)
                if len(hits):
                    if not near[k]:
                        np.add.at(self.edge, hits, 1)
                        np.add.at(self.edge, hits + len(lists), -1)
                    for d in np.unique(np.searchsorted(self.starts, hits, "right") - 1).tolist():
                        self.found[near[k]][d].add(windows[k])

        def result(self) -> pa.RecordBatch:
            hit = np.r_[0, np.cumsum(np.cumsum(self.edge) > 0)]
            ends = self.starts + self.n_words.to_numpy()
            columns = [self.keys, self.ids, self.n_words, pa.array(hit[ends] - hit[self.starts]), *(pa.array([sorted(x) for x in sets], pa.list_(pa.int64())) for sets in self.found)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "id", "n_words", "n_hit", "windows", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            number = batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else []
            for a, b in zip(first, [*first[1:], len(number)], strict=True):
                part = batch.slice(int(a), int(b - a))
                if part.column(4)[0].is_valid:  # a segment's own row comes first
                    if now:
                        yield now.result()
                    now, part = Segment(part, 0), part.slice(1)
                if part.num_rows:
                    lists = part.column(3)
                    offsets = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
                    now.look_up(part.column(1).to_pylist(), part.column(2).to_pylist(), offsets, lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        if now:
            yield now.result()

    both = index.withColumnRenamed("terms", "known").unionByName(wanted, allowMissingColumns=True)
    both = both.select("segment", "window", "near", "terms", "keys", "ids", "n_words", "starts", "known", "bounds", "postings")
    return both.repartition("segment").sortWithinPartitions("segment", F.col("window").isNotNull()).mapInArrow(run, FOUND)


def contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside an occurrence of a test window), n_items, items_sha256, n_near (items
    with a proximity match), contaminated (n_hit > 0 and at least a twentieth of the words).

    A window is ``window`` consecutive words of an item; a shorter item that has words is one window. Null texts have no
    words; items without words are in no result; a null item id is named ``null``; repeated items count once. Repeated
    documents and null ids keep their rows; an empty table of tests gives zeros, one of documents no rows. Documents and items of any length
    are read whole; other columns, whatever their names, are not read.
    """
    items = tests.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), words_of(F.col(item_text)).alias("w")).where("size(w) > 0").distinct()
    items = stored(items, "items")
    terms = items.select(F.explode(F.transform("w", lambda x: F.xxhash64(x))).alias("t")).distinct()
    sent = terms.limit(SENT_TERMS + 1).toArrow()["t"].to_numpy().view(np.uint64)
    index = build_index(docs, np.sort(sent) if len(sent) <= SENT_TERMS else None, id_col, text_col)
    wanted, names = lookups(items, index, window)
    found = stored(match(index, wanted), "matches")
    own = items.select(F.xxhash64("name", F.array_join("w", " ")).alias("window"), "name")

    def named(column: str, of: DataFrame) -> DataFrame:
        return found.select("key", F.explode(column).alias("window")).join(of, "window").select("key", "name").distinct()

    exact = named("windows", names).groupBy("key").agg(F.array_sort(F.collect_list("name")).alias("items"))
    close = named("near", own).groupBy("key").agg(F.count("*").alias("n_near"))
    met = found.join(exact, "key", "left").join(close, "key", "left")
    n_items = F.coalesce(F.size("items"), F.lit(0))
    out = met.select(F.col("id").alias(id_col), "n_words", "n_hit", F.when(n_items > 0, n_items).otherwise(0).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go. Rows with equal ids (or none) go if one of them is contaminated. Null texts are clean;
    columns stay as they are, whatever their names; an empty table stays empty."""
    small_batches(spark)
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    (name,) = fresh(docs, "gone")
    gone = found.where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
