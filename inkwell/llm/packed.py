"""Postings in packed rows: many fixed-width entries of one bucket in one row of bytes, so that a shuffle moves few rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, spread

SCHEMA = "bucket int, entries binary"
#: Entries a task gathers before it packs them, and the number that a bucket is planned for.
PACK, BUCKET = 1 << 19, 1 << 18
#: Up to so many buckets tasks pack entries for each bucket at once. A task's entries fill that many rows however few they are, so
#: with more buckets entries are dealt in two steps, by groups of buckets first.
DIRECT = 4096


class Deal:
    """How many entries of a type are dealt into buckets: their number follows that of the entries, their size doesn't."""

    def __init__(self, entries: int, dtype: np.dtype):
        self.count = max(8, -(-entries // BUCKET))
        self.in_two = self.count > DIRECT
        #: The entry type as it travels: in two steps each entry carries its bucket.
        self.dtype = np.dtype([*dtype.descr, ("bucket_", "<i4")]) if self.in_two else dtype

    def address(self, bucket: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What to pack: the entries under their buckets, or under groups of about the square root of all buckets."""
        if not self.in_two:
            return bucket, entries
        out = np.empty(len(entries), self.dtype)
        for f in entries.dtype.names:
            out[f] = entries[f]
        out["bucket_"] = bucket
        return bucket // np.int32(self.count**0.5), out

    def pack(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """parts: (bucket of each entry, entries as a structured array)."""
        return packed(self.address(*part) for part in parts)

    def regroup(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (unpack(data.as_buffer(), self.dtype) for batch in batches for data in batch.column(1))
        return packed((e["bucket_"], e) for e in parts)

    def rows(self, posted: DataFrame) -> DataFrame:
        """The packed rows with each bucket whole in one partition and sorted."""
        if self.in_two:
            posted = posted.repartition("bucket").mapInArrow(lean(self.regroup), SCHEMA)
        return posted.repartition(*spread(posted.sparkSession, self.count // 8), "bucket").sortWithinPartitions("bucket")

    def buckets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Whole buckets from rows that come sorted by bucket."""
        at, held = None, []
        for batch in batches:
            # a batch can hold much of a task's bytes, so rows are read where they lie
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and b != at:
                    yield at, np.concatenate(held)
                    held = []
                at = b
                held.append(unpack(data.as_buffer(), self.dtype))
        if held:
            yield at, np.concatenate(held)


def packed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        bucket, entries = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, entries = bucket[order], entries[order]
        at, first = np.unique(bucket, return_index=True)
        # column after column, which compresses better than entry after entry
        rows = [b"".join(np.ascontiguousarray(part[f]).tobytes() for f in entries.dtype.names) for part in np.split(entries, first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "entries"])

    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= PACK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def unpack(data: pa.Buffer, dtype: np.dtype) -> np.ndarray:
    n, at = len(data) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for f in dtype.names:
        out[f] = np.frombuffer(data, dtype[f], n, at)
        at += n * dtype[f].itemsize
    return out
