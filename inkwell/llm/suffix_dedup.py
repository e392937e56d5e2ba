"""Operator 2: removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if it lies in a string of SIZE bytes that also starts in a document with a smaller id.

1. Anchors. Each window of SIZE bytes has one anchor, the leftmost of its K-byte strings with the least hash, so equal windows have
   equal anchors. Consecutive windows with one anchor form a context. Contexts are dealt into buckets by their anchor.
2. Within a bucket equal contexts are one: later documents' copies are marked whole. Anchors that are left with several different
   contexts (the edges of repeated passages) are open; all other text cannot hold a repeat that isn't marked yet.
3. The open contexts are dealt by anchor, so equal windows meet in one task, and each task sorts its contexts' suffixes by the
   difference-cover algorithm: sampled triples are sorted and named, the names recursed on, and the other suffixes merged in.
   Neighbours in that order whose first SIZE bytes are equal form a class, and the class's smallest document keeps its string.
4. Marks return to their documents.

Steps 1 and 2 are an exact filter: what they leave out occurs in one document only or is already marked. An anchor that very many
contexts have (found in a sample of the documents, which decides about the cost only) isn't used: its windows are contexts of their
own, each its own anchor, so that no task gets all that surrounds a common string.

Documents are known by id and a hash of their text throughout, never by a place in a scan, so results do not depend on how files are
split or on which executors are there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .packed import SCHEMA, Deal

SIZE = 50
K = 16
WINDOWS = SIZE - K + 1
#: Context bytes that are sorted at once; an anchor's contexts stay together.
BLOCK = 1 << 19
#: Windows of a text that are looked at together.
PART = 1 << 17
#: Documents within which a task thins out equal contexts before they are dealt.
THIN = 1024
#: One document in SAMPLE is looked at for hot anchors, those with about HOT contexts or more in all, of which tasks are sent MOST at most.
SAMPLE, HOT, MOST = 64, 1 << 16, 1 << 22
#: Prefix length at which names need no further recursion: a power of 3 beyond SIZE.
DEEP = 81

ENTRY = np.dtype([("anchor", "<u4"), ("context", "<u8"), ("row", "<i8"), ("doc", "<i8"), ("start", "<u4"), ("more", "u1"), ("left", "<u2"), ("right", "<u2"), ("known", "u1")])


def suffix_order(t: np.ndarray, covered: int = 1) -> np.ndarray:
    """Starts of the suffixes of t (numbers from 1 up) in the order of their first DEEP // covered symbols at least."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate((t, np.zeros(3, t.dtype))).astype(np.int64)
    # sampled suffixes: starts that are 1 or 2 modulo 3 (a start behind the end stands in where n is 1 modulo 3)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    top = int(s.max()) + 1
    if top < 1 << 21:  # a triple fits a 64-bit number
        triple = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
        order = np.argsort(triple)
        step = np.r_[True, np.diff(triple[order]) != 0]
    else:
        order = np.lexsort((s[sample + 2], s[sample + 1], s[sample]))
        x = sample[order]
        step = np.r_[True, (s[x[1:]] != s[x[:-1]]) | (s[x[1:] + 1] != s[x[:-1] + 1]) | (s[x[1:] + 2] != s[x[:-1] + 2])]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(step)
    if not step.all() and 3 * covered < DEEP:
        order = suffix_order(names, 3 * covered)
    sampled = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    # the others are ordered by their first symbol and the rank of what follows it
    others = np.arange(0, n, 3)
    wide = len(sampled) + 2
    others = others[np.argsort(s[others] * wide + rank[others + 1])]
    # merge: how many others come before each sampled suffix; by one symbol and a rank, or by two symbols and a rank
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.zeros(n + 4, np.int64)
    before[first] = np.searchsorted(s[others] * wide + rank[others + 1], s[first] * wide + rank[first + 1])
    if top * top * wide < 1 << 62:
        key = lambda i: (s[i] * top + s[i + 1]) * wide + rank[i + 2]
    else:
        known = np.unique(np.concatenate([s[i] * top + s[i + 1] for i in (others, second)]))
        key = lambda i: np.searchsorted(known, s[i] * top + s[i + 1]) * wide + rank[i + 2]
    before[second] = np.searchsorted(key(others), key(second))
    out = np.empty(len(sampled) + len(others), np.int64)
    mine = np.maximum.accumulate(before[sampled]) + np.arange(len(sampled))
    out[mine] = sampled
    free = np.ones(len(out), bool)
    free[mine] = False
    out[free] = others
    return out[out < n]


def repeated(contexts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each context the offsets of its windows that also start in a smaller document's context."""
    size = np.array([len(c) for c in contexts])
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    t = np.frombuffer(b"\0".join(contexts) + b"\0" * (SIZE + 1), np.uint8)
    end = int(begin[-1] + size[-1] + 1)
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    order = suffix_order(t[:end].astype(np.int64) + 1)
    at = order - begin[owner[order]]
    order = order[at <= size[owner[order]] - SIZE]  # starts of whole windows
    if not len(order):
        return [np.empty(0, np.int64) for _ in contexts]
    rows = np.lib.stride_tricks.sliding_window_view(t, SIZE)
    same = np.concatenate([(rows[order[i : i + (1 << 16)]] == rows[order[np.maximum(np.arange(i, min(i + (1 << 16), len(order))) - 1, 0)]]).all(axis=1) for i in range(0, len(order), 1 << 16)])
    same[0] = False
    head = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(docs[owner[order]], head), np.diff(np.r_[head, len(order)]))
    hit = np.sort(order[docs[owner[order]] > least])
    cut = np.searchsorted(hit, begin)
    return [hit[a:b] - s for a, b, s in zip(cut, np.r_[cut[1:], len(hit)], begin, strict=True)]


def hashed(words: np.ndarray, at: slice | np.ndarray, behind: slice | np.ndarray) -> np.ndarray:
    """Hashes of strings of K bytes from their two halves, which start at these places."""
    h = words[at] * np.uint64(0x9E3779B97F4A7C15)
    second = words[behind]
    h += (second ^ (second >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, first window, number of windows less one, hashes of the K bytes before and behind the anchor, 0 where
    there are fewer) of a text's contexts in order. PART windows are looked at together, so that a long text needs no more memory."""
    n = len(data) - SIZE + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    firsts, places, bits = [], [], np.uint64((PART + WINDOWS).bit_length())
    for begin in range(0, n, PART):
        m = min(PART, n - begin)
        end = begin + m + WINDOWS - 1
        # sliding minimum of (hash, place): the leftmost of equal strings wins, as equal windows must agree
        h = hashed(words, slice(begin, end), slice(begin + 8, end + 8))
        least, span = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * span <= WINDOWS:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        least = np.minimum(least[:m], least[WINDOWS - span : WINDOWS - span + m]) & np.uint64((1 << int(bits)) - 1)
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        firsts.append(new + begin)
        places.append(least[new].astype(np.int64) + begin)
    first, at = np.concatenate(firsts), np.concatenate(places)
    new = np.r_[True, at[1:] != at[:-1]]  # a context may reach from one part into the next
    first, at = first[new], at[new]
    before = np.where(at >= K, hashed(words, np.maximum(at - K, 0), np.maximum(at - K, 0) + 8), 0)
    last = len(data) - K
    behind = np.where(at + K <= last, hashed(words, np.minimum(at + K, last), np.minimum(at + K, last) + 8), 0)
    return hashed(words, at, at + 8), first, np.diff(np.r_[first, n]) - 1, before, behind


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """Hashes of the anchors of very many contexts, sorted. rows: row, doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data)[0].view(np.int64))], names=["h"])

    sample = rows.where(F.pmod(F.xxhash64("doc", "row"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, HOT // SAMPLE))
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(MOST).toArrow()["h"].to_numpy().view(np.uint64))


def contexts(rows: DataFrame, deal: Deal) -> DataFrame:
    """Packed contexts of all texts by their anchor. rows: row, doc, text (binary)."""
    hot = rows.sparkSession.sparkContext.broadcast(hot_anchors(rows))

    def thin(bucket: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Copies of a context that a smaller document here has too are known; they are dealt by their row, so that a context that many
        documents share doesn't fill its anchor's bucket."""
        order = np.lexsort((e["doc"], e["context"], e["anchor"]))
        x = e[order]
        head = np.flatnonzero(np.r_[True, (x["context"][1:] != x["context"][:-1]) | (x["anchor"][1:] != x["anchor"][:-1])])
        later = order[x["doc"] > np.repeat(x["doc"][head], np.diff(np.r_[head, len(x)]))]
        e["known"][later] = 1
        bucket[later] = e["row"][later] % deal.count
        return bucket, e

    def located(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((h >> np.uint64(32)) % np.uint64(deal.count)).astype(np.int32), h & np.uint64(0xFFFFFFFF)

    def of_text(row: int, doc: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        h, first, more, before, behind = anchors(data)
        single = np.empty(0, np.int64)
        if len(hot.value) and len(h):
            common = hot.value[np.minimum(np.searchsorted(hot.value, h), len(hot.value) - 1)] == h
            single = np.concatenate([np.empty(0, np.int64), *(np.arange(a, a + n + 1) for a, n in zip(first[common], more[common], strict=True))])
            h, first, more, before, behind = (x[~common] for x in (h, first, more, before, behind))
        out = np.zeros(len(h) + len(single), ENTRY)
        out["row"], out["doc"] = row, doc
        whole, alone = out[: len(h)], out[len(h) :]
        bucket, whole["anchor"] = located(h)
        whole["start"], whole["more"], whole["left"], whole["right"] = first, more, before >> np.uint64(48), behind >> np.uint64(48)
        whole["context"] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (first + more + SIZE).tolist(), strict=True)]
        if len(single):
            names = np.array([divmod(xxhash.xxh3_128_intdigest(data[a : a + SIZE]), 1 << 64) for a in single.tolist()], np.uint64)
            place, alone["anchor"] = located(names[:, 0])
            alone["start"], alone["context"], bucket = single, names[:, 1], np.r_[bucket, place]
        return bucket, out

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in (b.slice(i, THIN) for b in batches for i in range(0, b.num_rows, THIN)):
            held = [of_text(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            if held:
                yield thin(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return deal.rows(rows.mapInArrow(lambda batches: deal.pack(entries(batches)), SCHEMA))


def resolve(packed: DataFrame, deal: Deal) -> DataFrame:
    """Rows (row, doc, start, more, open): contexts that a smaller document has too (open null), and those of the smallest document
    where an anchor has several contexts and documents (open: a number of the anchor)."""

    def marks(e: np.ndarray, whole: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
        number = (np.int64(bucket) << np.int64(32)) | e["anchor"].astype(np.int64)
        for i in range(0, len(e), 1 << 16):
            x, part = e[i : i + (1 << 16)], slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x["row"]), pa.array(x["doc"]), pa.array(x["start"].astype(np.int64)), pa.array(x["more"].astype(np.int32)), pa.array(number[part], mask=whole[part])], names=["row", "doc", "start", "more", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, e in deal.buckets(batches):
            known = e["known"] == 1
            yield from marks(e[known], np.ones(int(known.sum()), bool), bucket)
            e = e[~known]
            if not len(e):
                continue
            e = e[np.lexsort((e["doc"], e["context"], e["anchor"]))]
            new_anchor = np.r_[True, e["anchor"][1:] != e["anchor"][:-1]]
            new_context = new_anchor | np.r_[True, e["context"][1:] != e["context"][:-1]]
            head = np.flatnonzero(new_context)
            least = np.repeat(e["doc"][head], np.diff(np.r_[head, len(e)]))
            later = e["doc"] > least
            group = np.cumsum(new_anchor) - 1
            start = np.flatnonzero(new_anchor)
            several = (np.add.reduceat(new_context.astype(np.int64), start) > 1) & (np.minimum.reduceat(e["doc"], start) < np.maximum.reduceat(e["doc"], start))
            # a string of SIZE bytes around an anchor of K holds the K bytes before or the K bytes behind it, so a context can
            # share one only with a context of its anchor that has equal bytes there
            chosen = np.flatnonzero(~later & several[group])
            partner = np.zeros(len(chosen), bool)
            for side in ("left", "right") if len(chosen) else ():
                key = (group[chosen] << 16) | e[side][chosen]
                order = np.lexsort((e["context"][chosen], key))
                k, c = key[order], e["context"][chosen][order]
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                mixed = np.maximum.reduceat(c, first) != np.minimum.reduceat(c, first)
                partner[order] |= np.repeat(mixed, np.diff(np.r_[first, len(k)]))
            take = later.copy()
            take[chosen[partner]] = True
            e, later = e[take], later[take]
            yield from marks(e, later, bucket)

    return packed.mapInArrow(run, "row long, doc long, start long, more int, open long")


def lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of a column of lists of structs of numbers, and the structs' fields one after the other."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return sizes, [x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten()]


def cut_out(asked: DataFrame) -> DataFrame:
    """The open contexts with their bytes: (open, row, doc, start, context). asked: row, doc, text, want (array of open, start, more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, (number, start, more) = lists(batch.column(3))
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            texts = batch.column(2).to_pylist()
            parts = [texts[i][a:b] for i, a, b in zip(owner.tolist(), start.tolist(), (start + more + SIZE).tolist(), strict=True)]
            row, doc = (batch.column(i).to_numpy()[owner] for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(row), pa.array(doc), pa.array(start), pa.array(parts, pa.binary())], names=["open", "row", "doc", "start", "context"])

    return asked.mapInArrow(run, "open long, row long, doc long, start long, context binary")


def settle(open_: DataFrame) -> DataFrame:
    """Windows of open contexts that a smaller document has too, as (row, doc, start, more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            rows, docs, starts, more = [], [], [], []
            for (_, row, doc, start, _), at in zip(held, repeated([h[4] for h in held], np.array([h[2] for h in held], np.int64)), strict=True):
                if len(at):
                    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                    last = np.r_[first[1:], len(at)] - 1
                    rows += [row] * len(first)
                    docs += [doc] * len(first)
                    starts += (start + at[first]).tolist()
                    more += (at[last] - at[first]).tolist()
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (rows, docs, starts)), pa.array(more, pa.int32())], names=["row", "doc", "start", "more"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield from block()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield from block()

    return open_.repartition("open").sortWithinPartitions("open").mapInArrow(run, "row long, doc long, start long, more int")


def strip(marked: DataFrame, keep: bool) -> DataFrame:
    """Cuts the marked bytes out. marked: id, text (binary), marks (array of start, more) or null."""
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at_mark = [], 0
            sizes, (starts, more) = lists(batch.column(2))
            ends = starts + more + SIZE
            for doc, data, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes.tolist(), strict=True):
                kept, at, spans = [], 0, 0
                marks = slice(at_mark, at_mark + n)
                at_mark += n
                for start, end in sorted(zip(starts[marks].tolist(), ends[marks].tolist(), strict=True)):
                    if start > at or not spans:
                        kept.append(data[at:start])
                        spans += 1
                    at = max(at, end)
                left = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest(), left)[: 6 if keep else 5])
            types = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = zip(*out, strict=True) if out else [[]] * (6 if keep else 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names[: 6 if keep else 5])

    return marked.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with ``keep`` also the kept bytes.

    Null and empty texts have no bytes. Matches never cross documents or use what lies between two rows. Rows with equal ids don't remove
    each other's bytes, as neither id is smaller; a null id is smaller than all others. Texts of any length are read whole. Repeated rows
    each give a row. Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.encode(text, "UTF-8").alias("text"))
    sized = rows.select("row", "doc", "text")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    deal = Deal(2 * total // (WINDOWS + 1), ENTRY)
    marks = stored(resolve(contexts(sized, deal), deal), "marks")
    want = marks.where("open is not null").groupBy("row", "doc").agg(F.collect_set(F.struct("open", "start", "more")).alias("want"))
    asked = sized.join(want, ["row", "doc"]).select("row", "doc", "text", "want")
    edges = stored(settle(cut_out(asked)), "marks")
    spans = marks.where("open is null").select("row", "doc", "start", "more").unionByName(edges)
    spans = spans.groupBy("row", "doc").agg(F.collect_set(F.struct("start", "more")).alias("marks"))
    return strip(rows.join(spans, ["row", "doc"], "left").select("id", "text", "marks"), keep).withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
