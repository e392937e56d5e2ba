"""Near copies of documents: an exact join of their sets of shingles by Jaccard similarity.

Two sets whose similarity is SIMILAR or more share a shingle within the first size - ceil(SIMILAR * size) + 1 of each, in any order
that is the same for all (prefix filtering; Bayardo et al., AllPairs, 2007; positions: Xiao et al., PPJoin, 2008). Each distinct set is
posted under these shingles, those that are common in a sample of the documents last, so that they are seldom posted; the sample
decides about the cost only. Pairs that meet pass two filters that lose none (the shingles left behind the one they meet under; the
parities of the shingles' counts in as many classes as a set has shingles or more, which differ in no more classes than shingles) and
are verified by their sets.

Links that another method finds (the pipeline's stage: SimHash) are verified by the sets first; pairs of the join that these connect
already are not compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, stored
from .packed import SCHEMA, Deal

#: Words of a shingle; similarity 0.8 is 4 / 5 in the integer tests below.
SHINGLE = 5
#: Classes of a sketch: the least power of two that is not below the size, between these.
LEAST_SKETCH, MOST_SKETCH = 512, 1 << 16
#: Documents of the sample, the count there from which a shingle is common, and the most common ones that tasks are sent.
SAMPLE, COMMON, MOST = 16384, 2, 1 << 18
#: Lists longer than this are compared as groups (see grouped_links) instead of as pairs.
PAIRWISE = 128
#: Sets of a group that one task compares with each other.
BLOCK = 2000
#: Wanted sets are broadcast as hashes up to this number (8 bytes each); beyond it the join shuffles.
BROADCAST_SETS = 1_000_000

ENTRY = np.dtype([("key", "<u8"), ("ref", "<i8"), ("size", "<u4"), ("at", "<u4")])


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words as in operator 6. Fewer words than a shingle make one of all words."""
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in (text or b"").lower().split()], np.uint64)
    size = min(SHINGLE, len(w))
    h = np.zeros(len(w) - size + 1 if size else 0, np.uint64)
    for i in range(size):
        h = (h ^ w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def name_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))


def simhash_of(s: np.ndarray) -> int:
    """SimHash fingerprint of a set, as a signed long: a bit is set if over half of the shingles' hashes have it; the empty set's is zero."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def classes(size: int) -> int:
    return min(max(LEAST_SKETCH, 1 << max(0, size - 1).bit_length()), MOST_SKETCH)


def sketch(s: np.ndarray, n: int) -> np.ndarray:
    """Parities of the counts in n classes, as 64-bit words. The halves of a sketch give that of half as many classes by exclusive or."""
    return np.packbits(np.bincount(s & np.uint64(n - 1), minlength=n) & 1).view("<u8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more; both empty: yes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def may_be_similar(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The same by sizes (n, m) and the number of classes whose parities differ alone; never no where similar() says yes."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * apart <= n + m)


def classes_apart(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    while len(a) != len(b):
        a, b = (a, b) if len(a) < len(b) else (b, a)
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def encoded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))


def named_sets(texts: DataFrame) -> DataFrame:
    """Rows (id, name, n, sketch, fp): each document's set by hash, size, sketch and SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, classes(len(s))).tobytes() for s in sets], pa.binary()), pa.array([simhash_of(s) for s in sets], pa.int64())], names=["id", "name", "n", "sketch", "fp"])

    return texts.mapInArrow(lean(run), "id long, name long, n long, sketch binary, fp long")


def common_shingles(texts: DataFrame, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of about SAMPLE distinct texts, sorted, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["h"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n_texts // SAMPLE))) == 0).select("text").distinct()
    counts = sample.mapInArrow(lean(run), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "h").limit(MOST).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a set is posted under, rarest first (ties: by hash)."""
    seen = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        seen = np.where(common[at] == s, counts[at], 0)
    return s[np.argsort(seen, kind="stable")][: len(s) - (4 * len(s) + 4) // 5 + 1]


def postings(texts: DataFrame, common: np.ndarray, counts: np.ndarray, deal: Deal) -> DataFrame:
    """Packed entries of all sets, each distinct set of a batch once."""
    sent = texts.sparkSession.sparkContext.broadcast((common, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                sets = {name_of(s): s for s in map(shingles, batch.column(0).to_pylist()) if len(s)}
                if not sets:
                    continue
                keys = [prefix(s, *sent.value) for s in sets.values()]
                each = [len(k) for k in keys]
                out = np.empty(sum(each), ENTRY)
                out["key"], out["at"] = np.concatenate(keys), np.concatenate([np.arange(n) for n in each])
                out["ref"], out["size"] = np.repeat(np.array(list(sets), np.int64), each), np.repeat([len(s) for s in sets.values()], each)
                yield ((out["key"] >> np.uint64(32)) % np.uint64(deal.count)).astype(np.int32), out

        yield from deal.pack(entries())

    return texts.select("text").mapInArrow(lean(run), SCHEMA)


def candidates(posted: DataFrame, deal: Deal) -> DataFrame:
    """Rows (a, b, gid): pairs of sets that meet under a shingle with enough shingles left (gid null), or, for lists longer than
    PAIRWISE, the sets a of the list gid (b null)."""

    def enough(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = x["size"].astype(np.int64), y["size"].astype(np.int64)
        return 9 * np.minimum(n - x["at"], m - y["at"]) >= 4 * (n + m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, e in deal.buckets(batches):
            e = e[np.argsort(e["key"], kind="stable")]
            first = np.flatnonzero(np.r_[True, e["key"][1:] != e["key"][:-1]])
            last = np.r_[first[1:], len(e)]
            two = first[last - first == 2]
            x, y = e[two], e[two + 1]
            good = (x["ref"] != y["ref"]) & enough(x, y)
            left, right, group, member = [x["ref"][good]], [y["ref"][good]], [], []
            for i in np.flatnonzero(last - first > 2):
                refs, at = np.unique((one := e[first[i] : last[i]])["ref"], return_index=True)
                if len(refs) > PAIRWISE:
                    group.append(np.full(len(refs), one["key"][:1].view(np.int64)[0]))
                    member.append(refs)
                elif len(refs) > 1:
                    one = one[at]
                    p, q = np.nonzero(np.triu(enough(one[:, None], one[None, :]), 1))
                    left.append(refs[p])
                    right.append(refs[q])
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            n, m = pairs.shape[1], sum(map(len, member))
            columns = [np.concatenate([pairs[0], *member]), np.concatenate([pairs[1], np.zeros(m, np.int64)]), np.concatenate([np.zeros(n, np.int64), *group])]
            none = np.arange(n + m) >= n
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=none), pa.array(columns[2], mask=~none)], names=["a", "b", "gid"])

    return deal.rows(posted).mapInArrow(lean(run), "a long, b long, gid long")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy() for i in (2, 4))
                apart = np.array([classes_apart(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)])
                yield batch.select([0, 1]).filter(pa.array(may_be_similar(n, m, apart)))

    x = nodes.select(F.col("name").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    y = nodes.select(F.col("name").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(lean(run), "a long, b long")


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (a, s): the wanted sets, as sorted hashes of 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {name_of(s): s for s in map(shingles, batch.column(0).to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["a", "s"])

    small = wanted.count() <= BROADCAST_SETS
    found = texts.select("text").mapInArrow(lean(run), "a long, s binary")
    return found.join(F.broadcast(wanted) if small else wanted, "a", "left_semi").groupBy("a").agg(F.first("s").alias("s"))


def pair_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    x, y = sets.select("a", F.col("s").alias("x")), sets.select(F.col("a").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def unlinked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) that the links don't connect yet."""
    found = components(links)
    found = stored(found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct(), "simhash-parts")
    x, y = found.select(F.col("node").alias("a"), F.col("component").alias("x")), found.select(F.col("node").alias("b"), F.col("component").alias("y"))
    open_ = pairs.join(x, "a", "left").join(y, "b", "left").where(F.col("x").isNull() | F.col("y").isNull() | (F.col("x") != F.col("y")))
    return open_.select("a", "b")


def grouped_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect the sets of long lists as all their links would; members: (gid, a). Dealt like the lists of operator 10."""

    def connect(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
        have = [np.frombuffer(s, "<u8") for _, s in rows]
        size = np.array([len(s) for s in have])
        seen = np.stack([sketch(s, min(classes(int(size.max())), 4096)) for s in have])
        label = np.arange(len(rows))
        for u in range(1, len(rows)):
            open_ = np.flatnonzero(may_be_similar(size[:u], size[u], np.bitwise_count(seen[:u] ^ seen[u]).sum(axis=1, dtype=np.int64)))
            open_ = open_[label[open_] != label[u]]
            while len(open_):
                v = open_[0]
                if similar(have[v], have[u]):
                    yield rows[v][0], rows[u][0]
                    label[label == label[u]] = label[v]
                    open_ = open_[1:][label[open_[1:]] != label[u]]
                else:
                    open_ = open_[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        for _, group in groupby(rows, key=lambda r: r[:3]):
            if found := list(connect([r[3:] for r in group])):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    sizes = members.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "gid").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.select("gid", "a", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "a").join(sets, "a")
    return dealt.select("gid", "i", "j", "a", "s").repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j", "a").mapInArrow(lean(run), "a long, b long")


def linked_sets(nodes: DataFrame, links: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Pairs (a, b) of sets that connect what links() connects: sets of equal fingerprints with the first of them, and the first ones of
    linked fingerprints."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("name").alias("first")), "fingerprint-firsts")
    same = nodes.join(firsts, "fp").where(F.col("name") != F.col("first")).select(F.col("first").alias("a"), F.col("name").alias("b"))
    x, y = firsts.select(F.col("fp").alias("x"), F.col("first").alias("a")), firsts.select(F.col("fp").alias("y"), F.col("first").alias("b"))
    across = links(firsts.select("fp"), firsts.count()).toDF("x", "y").join(x, "x").join(y, "y").select("a", "b")
    return same.union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """One row per document: id, component_id: the smallest id reachable over pairs whose sets of 5-word shingles have a Jaccard
    similarity of 0.8 or more.

    Null, empty and blank texts have the empty set and are copies of each other. A null id gets its group's smallest id, null if
    it has none. Repeated rows keep their rows. Texts of any length are read whole; other columns are left out, whatever their names; an empty
    table gives none. Ids are whole numbers. Sets are told apart, and verified, by 64-bit hashes. ``links`` (distinct fingerprints in a
    column fp, and how many; edges (a, b)) finds links of SimHash fingerprints, which the sets then verify; the join adds what it misses.
    """
    texts = encoded(docs, id_col, text_col)
    marked = stored(named_sets(texts), "shingle-sets")
    nodes = stored(marked.groupBy("name").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp")), "shingle-nodes")
    n_texts, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    deal = Deal(total // 5 + n_texts, ENTRY)
    found = stored(candidates(postings(texts, *common_shingles(texts, n_texts), deal), deal), "copy-candidates")
    pairs, members = found.where("gid is null").select("a", "b").distinct(), found.where("gid is not null").select("gid", "a").distinct()
    pairs = stored(likely(pairs, nodes), "copy-pairs")
    near = stored(likely(linked_sets(nodes, links), nodes), "simhash-pairs") if links else pairs.limit(0)
    wanted = pairs.union(near)
    wanted = stored(wanted.select("a").union(wanted.select("b")).union(members.select("a")).distinct(), "sets-wanted")
    sets = stored(sets_of(texts, wanted), "sets")
    if links:
        near = stored(pair_links(near, sets), "simhash-links")
        pairs = unlinked(pairs, near)
    parts = components(near.union(pair_links(pairs, sets)).union(grouped_links(members, sets)))
    parts = stored(parts.unionByName(parts.select(F.col("component").alias("node"), "component")).distinct(), "copy-parts")
    named = nodes.join(parts, F.col("name") == F.col("node"), "left").select("name", F.coalesce("component", "name").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(least, "component").select("name", "component_id"), "name").select(F.col("id").alias(id_col), "component_id")
