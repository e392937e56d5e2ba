"""The pipeline's near-copy stage against a Jaccard brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import near_copies, simhash
from inkwell.llm.common import table

from . import brute

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = brute.low(text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """(id, smallest id of the group) of rows (id, text)."""
    s = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if (5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]))]
    part = brute.groups(len(rows), pairs)
    least = {}
    for p, (d, _) in zip(part, rows, strict=True):
        if d is not None:
            least[p] = min(d, least.get(p, d))
    return [(d, least.get(p)) for (d, _), p in zip(rows, part, strict=True)]


def variants(seed=3):
    """Texts with runs of changed words at all similarities around 0.8, and what is short, blank, null or repeated."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, i = [], 0
    for size in (6, 12, 40, 150, 400):
        base = [word() for _ in range(size)]
        for n in [0, *range(1, max(2, size // 5))][:24]:
            at = rng.randrange(size - n + 1)
            rows.append((i := i + 1, " ".join([*base[:at], *(word() for _ in range(n)), *base[at + n :]])))
    more = [(901, None), (902, ""), (903, " \n"), (904, "one two"), (905, "One  two"), (906, "one two three"), (None, "one two"), (None, "lonely words"), (5, rows[4][1]), (5, rows[4][1])]
    return rows + more


@pytest.mark.parametrize("pairwise", [64, 1])
def test_near_copies_match_brute_force(spark, pairwise, monkeypatch):
    """As pairs, and with all lists as groups in blocks of a few sets."""
    monkeypatch.setattr(near_copies, "PAIRWISE", pairwise)
    monkeypatch.setattr(near_copies, "BLOCK", 2000 if pairwise > 1 else 9)
    data = variants()
    got = near_copies.near_copies(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(groups(data), key=str)


def test_simhash_stage_reaches_jaccard(spark):
    data = variants(5)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = groups(data)
    kept = {d for d, c in want if d == c} - {d for d, c in want if d != c}
    assert {r["doc_id"] for r in simhash.stage(spark, docs, SF).collect()} == kept
    docs = table(spark, SF, "documents").select("doc_id", "text")
    assert {r["doc_id"] for r in simhash.stage(spark, docs, SF).collect()} == {d for d, c in groups([tuple(r) for r in docs.collect()]) if c == d}
    assert simhash.stage(spark, docs.limit(0), SF).count() == 0


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(7)
    for size in (3, 500, 513, 1100, 5000, 140_000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0, 0.05, 0.1, 0.11, 0.2):
            b = np.unique(np.concatenate([a[int(len(a) * share) :], rng.integers(0, 1 << 63, int(len(a) * share), dtype=np.uint64)]))
            apart = near_copies.classes_apart(*(near_copies.sketch(s, near_copies.classes(len(s))).tobytes() for s in (a, b[: int(len(b) * 0.99) + 1])))
            assert apart <= len(np.setxor1d(a, b[: int(len(b) * 0.99) + 1]))


def test_the_stage_links_by_simhash_and_verifies(spark, monkeypatch):
    """Without the join's pairs, what the fingerprints link is left: near copies in few bits go, and sets that only share bits stay."""
    base = [f"w{i}" for i in range(600)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join([*base[:-1], "third"])), (4, "one two"), (5, None), (6, " ")]
    rows += [(10 + i, " ".join(f"x{i}y{k}" for k in range(40))) for i in range(20)]
    bits = [(near_copies.simhash_of(np.unique(near_copies.shingles(t.encode()))) ^ near_copies.simhash_of(near_copies.shingles(rows[0][1].encode()))) & (1 << 64) - 1 for _, t in rows[1:3]]
    assert all(b.bit_count() <= simhash.MAX_BITS for b in bits)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nothing = spark.createDataFrame([], "a long, b long, gid long")
    monkeypatch.setattr(near_copies, "candidates", lambda posted, deal: nothing)
    assert {r["doc_id"] for r in simhash.stage(spark, docs, SF).collect()} == {1, 4, 5, *range(10, 30)}
    every = lambda distinct, n: distinct.select(F.col("fp").alias("a")).crossJoin(distinct.select(F.col("fp").alias("b"))).where("a < b")
    monkeypatch.setattr(simhash, "links", every)  # links of all fingerprints are cut down to near copies
    assert {r["doc_id"] for r in simhash.stage(spark, docs, SF).collect()} == {1, 4, 5, *range(10, 30)}
