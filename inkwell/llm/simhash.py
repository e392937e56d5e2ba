"""Operator 6: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 byte positions. Two fingerprints that differ in at most 3 bits share the byte at 5 positions or more, so
5 is the guaranteed number of matches. The index holds a list of fingerprints for each (position, byte). One list alone has a 256th of all
fingerprints, so pairs within it grow with the square of the input; lists are therefore intersected: postings go
under each choice of ``depth`` positions with their bytes, the least depth at which a list is expected to be short, and a list that is
still long is intersected with those of further positions. Pairs that share 5 positions meet under each choice from these. In a list
the shared positional bytes are tallied per pair; pairs with the guaranteed tally are retained, each in the first of its
lists, and verified by their bit distance. Only a spanning forest of a task's links is passed on, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, small_batches, spread, stored, table
from .near_copies import near_copies

SHINGLE = 3
MAX_BITS = 3
POSITIONS = 8
SHARED_BYTES = POSITIONS - MAX_BITS
#: Lists are intersected until they are expected to have no more members than this.
EXPECTED = 64
#: Lists up to this length are compared pair by pair; longer ones are intersected further and, at SHARED_BYTES positions, probed.
PAIRWISE = 64
#: Fingerprints whose pairs are tallied at once.
CHUNK = 1 << 18


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """A-Z are lower-cased; bytes.split() parts at ASCII blanks. A bit is set if over half of the shingles' hashes have it."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (id, fp): every document's fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(x, size)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def tallied(fps: np.ndarray, lists: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within lists. fps: the lists' members one after the other; lists: each member's list; positions: the bits of
    the positions that its list stands for. A pair that meets in several lists is kept in that of its first shared positions."""
    left, right, at = [], [], np.arange(len(fps) - 1)
    shift = 1
    while len(at):
        at = at[at < len(fps) - shift]
        at = at[lists[at] == lists[at + shift]]
        diff = fps[at] ^ fps[at + shift]
        same = diff.view(np.uint8).reshape(-1, POSITIONS) == 0
        tally = np.cumsum(same, axis=1, dtype=np.uint8)
        keep = (tally[:, -1] >= SHARED_BYTES) & (np.bitwise_count(diff) <= MAX_BITS)
        own = positions[at[keep]]
        leading = np.packbits(same[keep] & (tally[keep] <= np.bitwise_count(own)[:, None]), axis=1, bitorder="little")[:, 0]
        pick = at[keep][leading == own]
        left.append(fps[pick])
        right.append(fps[pick + shift])
        shift += 1
    return tuple(np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right))


def probed(fps: np.ndarray, positions: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of a list at SHARED_BYTES positions. Its members differ only in the other 3 bytes: a table of 2^24
    entries finds each fingerprint within MAX_BITS."""
    n = len(fps)
    label = np.arange(n)
    free = [8 * p + i for p in range(POSITIONS) if not (positions >> p) & 1 for i in range(8)]
    rest = np.zeros(n, np.int64)
    for k, bit in enumerate(free):
        rest |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << len(free), -1, np.int32)
    place[rest] = np.arange(n, dtype=np.int32)
    flips = [sum(1 << b for b in bits) for k in range(1, MAX_BITS + 1) for bits in combinations(range(len(free)), k)]
    while True:
        new = label.copy()
        for flip in flips:
            other = place[rest ^ flip]
            have = other >= 0
            new[have] = np.minimum(new[have], label[other[have]])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(n))
    return fps[label[far]], fps[far]


def intersected(fps: np.ndarray, positions: int, most: int) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(members, positions, whether short) of the lists that a list longer than ``most`` is split into: short ones and, at SHARED_BYTES
    positions, long ones. Its pairs with enough shared positions meet in one of them: that of their first positions."""
    for p in range(positions.bit_length(), POSITIONS):
        byte = (fps >> np.uint64(8 * p)).astype(np.uint8)
        order = np.argsort(byte, kind="stable")
        for members in np.split(fps[order], np.flatnonzero(np.diff(byte[order])) + 1):
            if len(members) < 2:
                continue
            now = positions | 1 << p
            if len(members) <= most or now.bit_count() == SHARED_BYTES:
                yield members, now, len(members) <= most
            else:
                yield from intersected(members, now, most)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that connect what all pairs (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, keep = list(range(len(nodes))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def depth_for(n: int) -> int:
    """Positions to post under so that a list has EXPECTED members at most, were fingerprints spread evenly."""
    depth = 1
    while depth < SHARED_BYTES and n > EXPECTED << (8 * depth):
        depth += 1
    return depth


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all links do. ``distinct``: one column, fp, of n rows."""
    chosen = [sum(1 << p for p in c) for c in combinations(range(POSITIONS), depth_for(n))]
    masks = [sum(0xFF << (8 * p) for p in range(POSITIONS) if c >> p & 1) for c in chosen]
    short = PAIRWISE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # members of the list that goes on in the next batch
        at = None
        wait: list[tuple[np.ndarray, np.ndarray]] = []  # short lists: members, positions; each list in a row

        def edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = forest(a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def tally() -> Iterator[pa.RecordBatch]:
            if wait:
                fps, positions, sizes = (np.concatenate(x) for x in zip(*wait, strict=True))
                wait.clear()
                yield from edges(*tallied(fps, np.repeat(np.arange(len(sizes)), sizes), positions))

        def long(members: np.ndarray, positions: int) -> Iterator[pa.RecordBatch]:
            parts = intersected(members, positions, short) if positions.bit_count() < SHARED_BYTES else [(members, positions, False)]
            size = 0
            for part, now, is_short in parts:
                if is_short:
                    wait.append((part, np.full(len(part), now, np.uint8), np.array([len(part)])))
                    size += len(part)
                    if size > CHUNK:
                        yield from tally()
                        size = 0
                else:
                    yield from edges(*probed(part, now))
            yield from tally()

        def ended(members: np.ndarray, choice: int) -> Iterator[pa.RecordBatch]:
            if len(members) > short:
                yield from long(members, chosen[choice])
            elif len(members) > 1:
                wait.append((members, np.full(len(members), chosen[choice], np.uint8), np.array([len(members)])))

        for batch in batches:
            choice, key, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fps = np.ascontiguousarray(fps).view(np.uint64)
            if not len(fps):
                continue
            first = np.r_[0, np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1]
            if held and (choice[0], key[0]) != at:
                yield from ended(np.concatenate(held), at[0])
                held = []
            if len(first) == 1:
                held.append(fps)
            else:
                yield from ended(np.concatenate([*held, fps[: first[1]]]), int(choice[0]))
                sizes = np.diff(first)[1:]
                for k in (np.flatnonzero(sizes > short) + 1).tolist():
                    yield from long(fps[first[k] : first[k + 1]], chosen[int(choice[first[k]])])
                some = (sizes > 1) & (sizes <= short)
                inside = np.repeat(some, sizes)
                whole = slice(first[1], first[-1])
                if some.any():
                    wait.append((fps[whole][inside], np.array(chosen, np.uint8)[choice[whole][inside]], sizes[some]))
                held = [fps[first[-1] :]]
            at = (int(choice[-1]), key[-1])
            yield from tally()
        if held:
            yield from ended(np.concatenate(held), at[0])
        yield from tally()

    posts = distinct.select("fp", F.posexplode(F.array(*(F.lit(signed(m)) for m in masks))).alias("choice", "mask"))
    posts = posts.select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    parts = spread(distinct.sparkSession, n * len(masks) // (1 << 21))
    return posts.repartition(*parts, "choice", "key").sortWithinPartitions("choice", "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id: the smallest id reachable over links.

    Null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle make one shingle of
    all words. A null id gets its group's smallest id, null if it has none. Repeated rows keep their rows. Groups are formed
    over distinct fingerprints, so equal ones, however many, are one node; very long texts are read whole. Other columns, whatever
    their names, are not read; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    parts = components(links(nodes.select("fp"), nodes.count()))
    parts = stored(parts.unionByName(parts.select(F.col("component").alias("node"), "component")).distinct(), "parts")
    named = nodes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(least, "component").select("fp", "component_id")
    return marked.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (5-word shingles, Jaccard 0.8 or more) the document with the smallest id stays.

    SimHash fingerprints of the 5-word shingles are linked by operator 6's index at MAX_BITS bits or fewer and verified by their sets; near
    copies that differ in more bits come from an exact join (near_copies).
    An id goes if any of its rows is in a group with a smaller id; rows with equal ids stay or go together. Rows without an id go
    where their group has an id, and stay otherwise. Null, empty and blank texts are one group; texts of any length are read whole. Columns
    stay as they are, whatever their names; an empty table stays empty. Ids are whole numbers.
    """
    small_batches(spark)
    groups = near_copies(docs.select("doc_id", "text"), links=links)
    (name,) = fresh(docs, "gone")
    gone = groups.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
