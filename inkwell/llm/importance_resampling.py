"""Operator 13: importance resampling towards a target distribution (Xie et al., DSIR, 2023) over hashed n-grams.

Within each block of texts the distinct words get integer ids and n-grams are tuples of ids; each distinct tuple's bytes are hashed once,
a longer tuple's hash going on from its prefix's, and the bucket is joined back to where the tuple stands. The buckets' counts in
the corpus and in the target give each bucket a gain; a document's weight is the sum over its features, and its score adds noise that
its id alone decides (Gumbel's), so that the highest scores are a sample without replacement by weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, table

#: Words of the longest feature, buckets, and the words that a document needs to be drawn.
GRAM, BUCKETS, LEAST_WORDS = 3, 10_000, 20
#: Share of the eligible documents that is drawn, in hundredths.
SHARE = 5
SEED = 42
#: Bytes of text that are one block (a longer text is one of its own), and distinct words a task keeps; at the limit it starts anew,
#: which changes no result.
BLOCK, KEPT_WORDS = 1 << 22, 1 << 20
#: Characters of words: digits, letters in lower case and all beyond ASCII; A-Z become a-z, the rest separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words(dict):
    """Ids of words in the order of their first sight, with the bytes that a tuple goes on with, and their hashes."""

    def __init__(self):
        super().__init__()
        self.after: list[bytes] = []
        self.crc = np.empty(0, np.uint32)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.after)
        self.after.append(b" " + word)
        return at

    def ids(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        # words are in the order of their ids, so those without a hash are the last
        if len(self.crc) < len(self.after):
            new = (crc32(memoryview(x)[1:]) for x in self.after[len(self.crc) :])
            self.crc = np.r_[self.crc, np.fromiter(new, np.uint32, len(self.after) - len(self.crc))]
        return out


def hashes(words: Words, ids: np.ndarray, room: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1 to GRAM the crc32 of the n-gram at each place; ``room``: words from the place to its text's end. Without room: 0."""
    at, crc = ids, words.crc
    yield crc[at]
    for n in range(2, GRAM + 1):
        fits = np.flatnonzero(room >= n)
        last = ids[fits + n - 1]
        pairs, back = np.unique((at[fits] << np.int64(32)) | last, return_inverse=True)
        ends = map(words.after.__getitem__, (pairs & np.int64(0xFFFFFFFF)).tolist())
        crc = np.fromiter(map(crc32, ends, crc[pairs >> np.int64(32)].tolist()), np.uint32, len(pairs))
        at = np.zeros(len(ids), np.int64)
        at[fits] = back
        out = np.zeros(len(ids), np.uint32)
        out[fits] = crc[back]
        yield out


def buckets_of(words: Words, texts: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All features' buckets, text after text, and each text's number of features."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = words.ids([x for t in texts for x in t])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    grid = np.stack([h % np.uint32(buckets) for h in hashes(words, ids, room)], axis=1)
    features = sum(np.maximum(sizes - n, 0) for n in range(GRAM))
    return grid[room[:, None] > np.arange(GRAM)].astype(np.uint16 if buckets <= 1 << 16 else np.uint32), features


def featured(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows (id, n_words, n_features, buckets): the features' buckets as packed numbers."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = kept.select("id").schema.add("n_words", "long").add("n_features", "long").add("buckets", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, BLOCK + (ends[start - 1] if start else 0), "right")))
                block = [(x or b"").translate(LETTERS).split() for x in texts[start:end].to_pylist()]
                if len(words) > KEPT_WORDS:
                    words = Words()
                found, features = buckets_of(words, block, buckets)
                offsets = np.r_[0, np.cumsum(features)] * found.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(found)])
                columns = [batch.column(0)[start:end], pa.array(map(len, block), pa.int64()), pa.array(features), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                start = end

    return kept.mapInArrow(run, schema)


def numbers(data: pa.Buffer, buckets: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if buckets <= 1 << 16 else np.uint32)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds: every task adds its own up, so a task posts a row a bucket at most, and the driver gets
    as many rows as there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.bincount(numbers(x.as_buffer(), buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in features.where("n_features > 0").select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of the ratio of both sides' shares, each count with one added, downwards."""
    s, t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows (id, n_words, n_features, weight)."""
    kept = features.select("id", "n_words", "n_features", "buckets")
    schema = kept.drop("buckets").schema.add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[numbers(x.as_buffer(), len(gain))].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def ranked(scored: DataFrame, share: int) -> DataFrame:
    """The rows with ``rank`` for the highest scores among the eligible ones; ties go to smaller ids.

    All rows are sorted by range and stored; a row's place is its place in its part plus the sizes of the parts before, so no task ranks
    more than a part. The sizes are one row a part."""
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight"]
    placed = stored(scored.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "resampled")
    part, own = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"))
    before = Window.orderBy("part")
    sizes = parts.select("part", (F.sum("n").over(before) - F.col("n")).alias("before"), F.floor(F.sum("n_eligible").over(Window.partitionBy()) * share / 100).alias("drawn"))
    rank = F.col("before") + own + 1
    met = placed.withColumn("part", part).join(F.broadcast(sizes), "part")
    return met.withColumn("rank", F.when(F.col("eligible") & (rank <= F.col("drawn")), rank))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: the id, n_words, n_features, weight, score and rank (null if not drawn). ``target``: rows with a column of
    the same name as the texts'.

    Null and empty texts, and those without a word, have no features and weight 0. ``share`` hundredths of the documents with at least
    ``least_words`` words are drawn, those with the highest scores; ties go to smaller ids. Repeated rows are rows like any other, and a
    null id is the empty one in the noise and comes last in ties. Texts of any length are read whole, in memory that grows with the
    longest; other columns are left out, whatever their names. An empty table gives none; with an empty target all gains are those of no counts.
    """
    features = stored(featured(docs, id_col, text_col, buckets), "features")
    corpus = bucket_counts(features, buckets)
    wanted = bucket_counts(featured(target.select(F.lit(None).cast("long").alias("none"), F.col(text_col).alias("text")), "none", "text", buckets), buckets)
    weights = weighted(features, gains(corpus, wanted))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    scored = stored(weights.select("*", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("eligible")), "scored")
    own = ("n_words", "n_features", "weight", "score", "rank")
    return ranked(scored, share).select(F.col("id").alias(id_col), *(F.col(n).alias(m) for n, m in zip(own, fresh(docs.select(id_col), *own), strict=True)))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
