"""Operator 4: cross-entropy difference with two matched n-gram models.

A model of the target documents and one of the background (all documents) share one vocabulary, order and smoothing; they differ only
in their counts. A token's loss difference is its log loss under the target model less that under the background
model; a document's score is the mean over its tokens, so lower means closer to the target (Moore and Lewis, 2010).

Tokens are words (A-Z lower-cased, split at ASCII blanks), known by a 64-bit hash; the vocabulary is that of all documents, however
many words it has, and no word or count goes to the driver. The models are bigrams over unigrams over a uniform distribution, each
smoothed by the next with a Dirichlet prior:

1. documents are stored in blocks of about BLOCK tokens: a block's distinct words, and its documents as numbers of these;
2. each block posts its distinct bigrams and words with their counts, dealt by key: one posting a block and key, however
   common the key is; with more than FAN blocks groups of blocks are added up first;
3. the counts are added up, and each block is sent those of its keys whose counts other blocks have changed;
4. each block scores its documents.

A bigram's history counts as often as its word occurs, or, at a document's start, as there are documents with tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored, table

#: Dirichlet priors: a bigram's count gains so many times its token's unigram probability, and a token's so many times the uniform one.
PRIOR, LOW_PRIOR = 50, 1000
#: The uniform distribution's probability.
UNIFORM = 1 / (1 << 20)
#: Tokens of a block, and postings that a bucket is planned for.
BLOCK, BUCKET = 1 << 20, 1 << 19
#: Blocks whose postings of a bucket meet in one task.
FAN = 4096
#: What a block has: tokens, those of target documents, documents with tokens, and such target documents.
TOTALS = ("n_tokens", "n_wanted", "n_texts", "n_wanted_texts")
#: Target ids are broadcast up to this number (8 bytes each for numbers); beyond it the join shuffles.
BROADCAST_TARGETS = 1_000_000

POSTED = "bucket int, block long, keys binary, target binary, background binary"
ANSWER = "bucket int, block long, places binary, target binary, background binary"


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z only; bytes.split() parts at ASCII blanks."""
    return (text or b"").lower().split()


def narrow(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, as many as the largest needs, the lowest first, and compressed: in skewed planes few bits are left."""
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    data = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + pa.compress(data, codec="zstd", asbytes=True)


def widened(data: bytes, n: int) -> np.ndarray:
    """The n numbers of narrow()."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        plain = pa.decompress(data[1:], decompressed_size=n * data[0], codec="zstd", asbytes=True)
        out[:, : data[0]] = np.frombuffer(plain, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<u8")


def key_bytes(keys: np.ndarray) -> bytes:
    """Sorted keys: their number, the first one, and the steps from each to the next."""
    return len(keys).to_bytes(8, "little") + keys[:1].tobytes() + narrow(np.diff(keys))


def key_count(data: bytes) -> int:
    return int.from_bytes(data[:8], "little")


def keys_from(data: bytes) -> np.ndarray:
    n = key_count(data)
    return np.cumsum(np.r_[np.frombuffer(data, "<u8", 1, 8), widened(data[16:], n - 1)], dtype=np.uint64)


def in_blocks(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored rows (block, ids, wanted, sizes, words, tokens, n_tokens, n_wanted, n_texts, n_wanted_texts): the documents of a block with their
    numbers of tokens, the hashes of the block's distinct words, the most frequent first, and all tokens as their numbers."""
    block_tokens = BLOCK
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type = rows.select("id").limit(0).toArrow().schema.field("id").type

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, []

        def whole() -> pa.RecordBatch:
            ids, wanted, tokens = zip(*held, strict=True)
            sizes = np.array([len(t) for t in tokens], np.int32)
            known, at, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(known), np.int64)
            rank[order] = np.arange(len(known))
            mine = sizes[np.array(wanted)]
            values = [block, list(ids), list(wanted), sizes, known[order].tobytes(), narrow(rank[at]), int(sizes.sum()), int(mine.sum()), int((sizes > 0).sum()), int((mine > 0).sum())]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["block", "ids", "wanted", "sizes", "words", "tokens", *TOTALS])

        size = 0
        for batch in batches:
            for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                t = np.fromiter(map(xxhash.xxh3_64_intdigest, words(text)), "<u8")
                if held and size + len(t) > block_tokens:
                    yield whole()
                    block, held, size = block + 1, [], 0
                held.append((key, wanted, t))
                size += len(t)
        if held:
            yield whole()

    wanted = targets.select(F.col(targets.columns[0]).alias("target_id")).dropna().distinct()
    small = wanted.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
    marked = rows.join(F.broadcast(wanted) if small else wanted, F.col("id") == F.col("target_id"), "left").select("id", "text", F.col("target_id").isNotNull().alias("wanted"))
    return stored(marked.mapInArrow(deal, f"block long, ids array<{kind}>, wanted array<boolean>, sizes array<int>, words binary, tokens binary, {' long, '.join(TOTALS)} long"), "lm-blocks")


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


class Block:
    """The keys of a block (of bigrams and words, sorted and distinct) with its own counts; ``places``: where each token's bigram, word
    and history are (-1: the document's start)."""

    def __init__(self, sizes: np.ndarray, wanted: np.ndarray, known: bytes, tokens: bytes):
        hashes, at = np.frombuffer(known, "<u8"), widened(tokens, int(sizes.sum())).astype(np.int64)
        before = np.r_[0, at[:-1]] + 1
        before[np.cumsum(np.r_[0, sizes])[:-1][sizes > 0]] = 0
        pairs, pair = np.unique(before * (len(hashes) + 1) + at, return_inverse=True)
        v, w = np.divmod(pairs, len(hashes) + 1)
        every = np.concatenate([mixed(mixed(np.r_[np.uint64(0), hashes], 1)[v] + hashes[w], 2), mixed(hashes, 3)])
        self.keys, place = np.unique(every, return_inverse=True)
        word = np.r_[-1, place[len(pairs) :]]
        self.places = [place[pair], word[at + 1], word[before]]
        here = np.repeat(wanted, sizes).astype(np.float64)
        self.target, self.background = (sum(np.bincount(p, x, len(self.keys)) for p in self.places[:2]).astype(np.int64) for x in (here, np.ones(len(at))))


def block_of(batch: pa.RecordBatch, i: int) -> Block:
    """Of a row (sizes, wanted, words, tokens)."""
    sizes, wanted = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(2))
    return Block(sizes.astype(np.int64), wanted.astype(bool), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """In the order of the keys, so a bucket's keys lie together in a block's."""
    return (((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def posted(blocks: DataFrame, n_buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = block_of(batch.select(range(1, 5)), i)
                at, first = np.unique(bucket_of(b.keys, n_buckets), return_index=True)
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(b.keys)], strict=True))
                parts = [[f(x[i:j]) for i, j in cuts] for f, x in ((key_bytes, b.keys), (narrow, b.target), (narrow, b.background))]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), batch.column(0)[i].as_py())), *(pa.array(p, pa.binary()) for p in parts)], names=["bucket", "block", "keys", "target", "background"])

    return blocks.select("block", "sizes", "wanted", "words", "tokens").mapInArrow(run, POSTED)


def runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other and are equal in their first n columns: (these, the rows' other columns)."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if held and row[:n] != at:
                yield at, held
                held = []
            at = row[:n]
            held.append(row[n:])
    if held:
        yield at, held


def added(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of rows (.., keys, target, background), each entry's place among them, and the sums."""
    kinds, at = np.unique(np.concatenate([keys_from(r[-3]) for r in rows]), return_inverse=True)
    sums = [np.zeros(len(kinds), np.int64) for _ in range(2)]
    for total, k in zip(sums, (-2, -1), strict=True):
        np.add.at(total, at, np.concatenate([widened(r[k], key_count(r[-3])) for r in rows]).astype(np.int64))
    return kinds, at, sums


def answers(bucket: int, rows: list[tuple], known: np.ndarray, at: np.ndarray, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each posting (block, keys, ..) which of its keys are ``known``, as bits, and their counts. at: each entry's place in known."""
    out, i = [], 0
    for block, keys, *_ in rows:
        mine = at[i : i + key_count(keys)]
        i += len(mine)
        if (sent := known[mine]).any():
            out.append((bucket, block, np.packbits(sent).tobytes(), *(narrow(s[mine[sent]]) for s in sums)))
    if out:
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "block", "places", "target", "background"])


def told(places: bytes, values: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and counts of an answer."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(places, np.uint8)))
    return at, [widened(x, len(at)).astype(np.int64) for x in values]


def corpus_counts(posts: DataFrame, n_blocks: int, n_buckets: int) -> DataFrame:
    """Rows (bucket, block, places, target, background): for each posting its keys (by their places in it) that other blocks hold
    too, with the counts over all blocks."""
    fan = FAN
    parts = spread(posts.sparkSession, n_buckets // 4)

    if n_blocks <= fan:

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (bucket,), rows in runs(batches, 1):
                kinds, at, sums = added(rows)
                yield from answers(bucket, rows, np.bincount(at, minlength=len(kinds)) > 1, at, sums)

        return posts.repartition(*parts, "bucket").sortWithinPartitions("bucket").mapInArrow(add, ANSWER)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, of), rows in runs(batches, 2):
            kinds, _, sums = added(rows)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([of], pa.int64()), *(pa.array([x], pa.binary()) for x in (key_bytes(kinds), *map(narrow, sums)))], names=["bucket", "block", "keys", "target", "background"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's blocks have the group's counts, replaced by those from above."""
        for (bucket, _), rows in runs(batches, 2):
            rows, sent = [r[:4] for r in rows if r[1] is not None], [r for r in rows if r[1] is None]
            kinds, at, sums = added(rows)
            known = np.bincount(at, minlength=len(kinds)) > 1
            for _, _, target, background, places in sent:
                places, values = told(places, [target, background])
                known[places] = True
                for total, x in zip(sums, values, strict=True):
                    total[places] = x
            yield from answers(bucket, rows, known, at, sums)

    posts = stored(posts, "lm-posts")
    n_groups = -(-n_blocks // fan)
    of = F.pmod(F.xxhash64("block"), F.lit(n_groups)).alias("of")
    dealt = posts.select("bucket", of, "block", "keys", "target", "background")
    sums = stored(dealt.repartition(*parts, "bucket", "of").sortWithinPartitions("bucket", "of").mapInArrow(group, POSTED), "lm-groups")
    above = corpus_counts(sums, n_groups, n_buckets).withColumnRenamed("block", "of")
    both = dealt.unionByName(above, allowMissingColumns=True).select("bucket", "of", "block", "keys", "target", "background", "places")
    return both.repartition(*parts, "bucket", "of").sortWithinPartitions("bucket", "of").mapInArrow(settle, ANSWER)


def score(blocks: DataFrame, counts: DataFrame, totals: dict[str, int], n_buckets: int, id_col: str) -> DataFrame:
    """Scores each block's documents with its own counts, replaced by those of all blocks where ``counts`` has them."""
    base = blocks.select(F.col("ids").getItem(0).alias(id_col))
    schema = base.schema.add("n_tokens", "long").add("target_loss", "double").add("background_loss", "double").add("score", "double")
    id_type = base.limit(0).toArrow().schema.field(id_col).type
    prior, low_prior, uniform = PRIOR, LOW_PRIOR, UNIFORM

    def scored(ids: list, sizes: np.ndarray, b: Block, sent: list[tuple]) -> pa.RecordBatch:
        count = [b.target, b.background]
        first = np.searchsorted(bucket_of(b.keys, n_buckets), np.arange(n_buckets))
        for bucket, places, *values in sent:
            at, values = told(places, values)
            for c, x in zip(count, values, strict=True):
                c[first[bucket] + at] = x
        full = np.flatnonzero(sizes)
        start = np.cumsum(np.r_[0, sizes[full]])[:-1]
        found = [np.full(len(ids), np.nan) for _ in range(2)]
        if len(full):
            for out, c, total, texts in zip(found, count, (totals["n_wanted"], totals["n_tokens"]), (totals["n_wanted_texts"], totals["n_texts"]), strict=True):
                pair, token, history = (np.r_[c, texts][p] for p in b.places)
                low = (token + low_prior * uniform) / (total + low_prior)
                out[full] = np.add.reduceat(-np.log((pair + prior * low) / (history + prior)), start) / sizes[full]
        columns = [pa.array(ids, id_type), pa.array(sizes), *(pa.array(x, pa.float64(), from_pandas=True) for x in (*found, found[0] - found[1]))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, 1):
            sent = [r[5:] for r in rows if r[0] is None]
            for ids, wanted, sizes, known, tokens, *_ in (r for r in rows if r[0] is not None):
                sizes = np.array(sizes, np.int64)
                yield scored(ids, sizes, Block(sizes, np.array(wanted, bool), known, tokens), sent)

    both = blocks.select("block", "ids", "wanted", "sizes", "words", "tokens").unionByName(counts, allowMissingColumns=True)
    both = both.select("block", "ids", "wanted", "sizes", "words", "tokens", "bucket", "places", "target", "background")
    return both.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, target_loss, background_loss (nats a token), score (their difference).

    ``targets``: ids of the target's documents (one column, of any size; repeated ids count once, null ids not at all). Without targets
    the target's model is the uniform one. A null, empty or blank text has no tokens and null losses. Repeated rows and null ids
    are rows like any other, and each counts in the models; very long texts are a block of their own; other columns aren't read.
    An empty table gives an empty result."""
    blocks = in_blocks(docs, targets, id_col, text_col)
    totals = blocks.agg(F.count("*").alias("n_blocks"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in TOTALS)).first().asDict()
    n_blocks, n_buckets = totals["n_blocks"], max(8, -(-totals["n_tokens"] // BUCKET))
    counts = corpus_counts(posted(blocks, n_buckets), n_blocks, n_buckets)
    return score(blocks, counts, totals, n_buckets, id_col)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good (quality 1). Background: all documents."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
