"""Operator 10: line deduplication by a segment-partition edit join.

Two lines are near-duplicates if few edits lead from one to the other: of characters, where the shorter one has few words, or of words. How
many grows with the shorter line and is a tenth of it at most (char_edits, word_edits). A line cut into k + 1 segments, of characters or of words, has a segment that a
partner within k edits holds unchanged near the same place (pigeonhole). Every line is indexed under (its length, segment
number, segment) and probes the indexes of its own and slightly smaller lengths with the substrings at which the segment may
start (multi-match-aware selection; Li et al., Pass-Join, 2011). Pairs that meet are verified by a banded bit-parallel
edit distance. Lines and their near-duplicates form classes; the first line of a class in document order is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import BLANKS, components, fresh, lean, small_batches, stored
from .packed import SCHEMA, Deal

#: Lines with fewer characters have no near-duplicates, only exact copies: one edit would be more than a tenth of them.
MIN_CHARS = 10
#: From so many characters on two of them may be edited, and from so many words on one word; one more for each doubling of the words.
TWO_EDITS, MIN_WORDS = 20, 10
#: Lines with so many words are compared by words only: two words may be edited, so two characters in most cases.
ONLY_WORDS = 20
#: Lists longer than this are compared as groups (see grouped_links) instead of as pairs.
PAIRWISE = 64
#: Lines of a group that one task compares with each other.
BLOCK = 2000
#: Wanted lines are broadcast up to this number (8 bytes each); beyond it the join shuffles.
BROADCAST_LINES = 1_000_000

PLACES = 1 << (4 * np.arange(8))
#: index: bit 0 for a line's own segments, above it the edits that its length allows.
ENTRY = np.dtype([("key", "<u4"), ("sig", "<u4"), ("ref", "<i8"), ("index", "u1")])
#: Keys of words are told from those of characters by this bit of the seed; characters of lines that are posted at a time.
WORD_KEYS, COUNTED = 1 << 40, 1 << 20
#: Base of the hashes of runs of units, odd, so that it has an inverse modulo 2^64; values of bytes; bytes between words.
BASE = 0x9E3779B97F4A7C15
BYTES = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([i])) for i in range(256)), ">u8").astype(np.uint64)
BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
#: Bits of a sketch.
SKETCH = 512
#: Texts whose lines are posted at a time.
TEXTS = 512


def char_edits(n: int) -> int:
    """Edits that a line of n characters allows."""
    return 0 if n < MIN_CHARS else 1 if n < TWO_EDITS else 2


def word_edits(n: int) -> int:
    """Edits of words that a line of n words allows."""
    return (n // MIN_WORDS).bit_length()


def words_of(line: str) -> list[bytes]:
    """The words of a line, if it may have enough of them."""
    return line.encode().split() if len(line) >= 2 * MIN_WORDS - 1 else []


def near(x: str, y: str) -> bool:
    """Whether two lines are near-duplicates."""
    a, b = words_of(x), words_of(y)
    if min(len(a), len(b)) < ONLY_WORDS and (k := char_edits(min(len(x), len(y)))) and within(x, y, k):
        return True
    return bool((k := word_edits(min(len(a), len(b)))) and within(a, b, k))


def within(a: Sequence, b: Sequence, k: int) -> bool:
    """Whether the Levenshtein distance of a and b, texts or lists of words, is at most k.

    Common ends are cut off; the rest runs through bit vectors of 2k + 1 rows around the diagonal. Bit i stands for row
    j - k + i of column j; D0 has a bit where the value equals the one diagonally before it, and the distance is followed along the
    diagonal that ends in the last cell."""
    n = min(len(a), len(b))
    at = 0
    while at < n and a[at] == b[at]:
        at += 1
    a, b, n = a[at:], b[at:], n - at
    at = 0
    while at < n and a[-1 - at] == b[-1 - at]:
        at += 1
    a, b = a[: len(a) - at], b[: len(b) - at]
    shift = len(a) - len(b)
    if abs(shift) > k:
        return False
    if not a or not b:
        return True
    places: dict[str | bytes, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << (2 * k + 1)) - 1
    vp, vn, score, diagonal = ((1 << k) - 1) << (k + 1), 0, abs(shift), 1 << (k + shift)
    for j, c in enumerate(b, 1):
        vp, vn = (vp >> 1) | (1 << (2 * k)), vn >> 1
        eq = places.get(c, 0)
        eq = (eq >> (j - k - 1) if j > k else eq << (k + 1 - j)) & full
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hp, hn = (vn | ~(d0 | vp)) & full, vp & d0
        hp1 = ((hp << 1) | 1) & full
        vp, vn = ((hn << 1) | ~(d0 | hp1)) & full, hp1 & d0
        if j + shift > 0 and not d0 & diagonal:
            score += 1
            if score > k:
                return False
    return True


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 segments of a line of n units; the later ones take the remainder."""
    base, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i > k - more)
        out.append((at, size))
        at += size
    return out


def probes(n: int, edits: Callable[[int], int]) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, end, is the line's own segment) of the parts of a line of n units to look up or post. A pair is
    held to the edits of its shorter line, so that line's length says how it is cut."""
    out = []
    for d in range(n + 1):
        k = edits(n - d)
        if d > k or not k:
            break
        for i, (p, size) in enumerate(segments(n - d, k)):
            for start in range(max(0, p - i, p + d - (k - i)), min(n - size, p + i, p + d + (k - i)) + 1):
                out.append((n - d, i, start, start + size, d == 0 and start == p))
    return out


def counted(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signatures of rows whose units' classes (0 to 7) stand one after the other: the counts modulo 16, 4 bits each."""
    row = np.repeat(np.arange(len(sizes)), sizes) * 8 + classes
    return (np.bincount(row, minlength=8 * len(sizes)).reshape(-1, 8) & 15) @ PLACES


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits (the end of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd number modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.fine = base, self.upto(base, 1024)
        self.coarse = self.fine[:1]

    @staticmethod
    def upto(base: int, n: int) -> np.ndarray:
        return np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])

    def reach(self, n: int) -> np.ndarray:
        """The powers of base^1024 that powers below n take."""
        if len(self.coarse) << 10 < n:
            self.coarse = self.upto(pow(self.base, 1024, 1 << 64), -(-n >> 10) + 1)
        return self.coarse

    def first(self, n: int) -> np.ndarray:
        return np.multiply.outer(self.reach(n)[: (n >> 10) + 1], self.fine).ravel()[:n]

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.reach(int(i.max(initial=0)) + 1)[i >> 10] * self.fine[i & 1023]


UP, DOWN = Powers(BASE), Powers(pow(BASE, -1, 1 << 64))


def run_sums(units: np.ndarray) -> np.ndarray:
    """Sums of units times powers of BASE, from which run_hashes takes those of runs."""
    return np.r_[np.uint64(0), np.cumsum(units * UP.first(len(units)))]


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the units from start to end, the same wherever these stand. Equal hashes of different units make candidates only."""
    return (sums[end] - sums[start]) * DOWN.at(start)


def characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' characters, one line after the other, and how many each has."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return mixed(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint64(1)), sizes


def word_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same of the words of words_of; also those of lines too short to have enough of them. No line has a newline in it."""
    data = np.frombuffer(("\n" + "\n".join(lines) + "\n").encode(), np.uint8)
    blank = BLANK[data]
    ends = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = ends[::2], ends[1::2]
    line = np.searchsorted(np.flatnonzero(data == 10), start) - 1
    return mixed(run_hashes(run_sums(BYTES[data]), start, end)), np.bincount(line, minlength=len(lines))


def signatures(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Counts of the units in 8 classes. An edit changes at most two counts by one."""
    return counted((units >> np.uint64(61)).astype(np.int64), sizes).astype(np.uint32)


def sketches(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SKETCH bits a line: whether the number of units that hash to a bit is odd. A unit put in or taken out changes one bit."""
    bit = (units >> np.uint64(32)).astype(np.int64) % SKETCH
    odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * SKETCH + bit, minlength=SKETCH * len(sizes)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH), axis=1).view(np.uint64)


def pairs_of(units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the neighbouring units in each line, and how many each has."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    inside = line[1:] == line[:-1]
    return mixed(units[:-1] * np.uint64(BASE) + units[1:])[inside], np.maximum(sizes - 1, 0)


def alike(a: np.ndarray, b: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Whether two signatures allow a distance of at most k."""
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for i in range(8):
        d = ((a >> np.uint32(4 * i)) - (b >> np.uint32(4 * i))) & np.uint32(15)
        total += np.minimum(d, np.uint32(16) - d)
    return total <= 2 * k


def may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two entries allow their lines to be near-duplicates."""
    k = np.minimum(x["index"] >> 1, y["index"] >> 1).astype(np.int64)
    return (x["ref"] != y["ref"]) & (((x["index"] | y["index"]) & 1) == 1) & alike(x["sig"], y["sig"], k)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, text_hash, no, line, a, b): lines that have a word, with two 64-bit hashes."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.split(text_col, "\n", -1)).alias("no", "line"))
    # most lines begin with a word, which is seen without a trimmed copy
    return rows.where((F.ascii("line") > 32) | (F.btrim("line", F.lit(BLANKS)) != "")).select("*", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def postings(docs: DataFrame, text_col: str, deal: Deal) -> DataFrame:
    """Packed index and probe entries of all lines of MIN_CHARS characters or more, each distinct line of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple[bool, int], np.ndarray] = {}

        def plan(words: bool, n: int) -> np.ndarray:
            """Seed, start, end and mark of the parts of a line of n units, in rows."""
            if (words, n) not in plans:
                edits = word_edits if words else char_edits
                found = [((WORD_KEYS if words else 0) + m * 16 + i, s, e, own + 2 * edits(n)) for m, i, s, e, own in probes(n, edits)]
                plans[words, n] = np.array(found, np.int64).reshape(-1, 4).T
            return plans[words, n]

        def lines(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[int]]]:
            """The batch's distinct lines and their hashes, some texts' and about COUNTED characters at a time."""
            posted: set[int] = set()
            for start in range(0, batch.num_rows, TEXTS):
                new = {x for t in batch.column(0)[start : start + TEXTS].to_pylist() for x in t.split("\n") if len(x) >= MIN_CHARS and x.strip(BLANKS)}
                out, hashes, size = [], [], 0
                for x in new:
                    if (h := xxhash.xxh64_intdigest(x.encode(), 42)) in posted:
                        continue
                    posted.add(h)
                    if out and size + len(x) > COUNTED:
                        yield out, hashes
                        out, hashes, size = [], [], 0
                    out.append(x)
                    hashes.append(h)
                    size += len(x)
                if out:
                    yield out, hashes

        def parts(words: bool, units: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Buckets and entries of the chosen lines; units and sizes are those of all lines."""
            start, own = (np.cumsum(sizes) - sizes)[chosen], sizes[chosen]
            lengths, which = np.unique(own, return_inverse=True)
            table = [plan(words, int(n)) for n in lengths]
            count = np.array([x.shape[1] for x in table], np.int64)
            each = count[which]
            row = np.repeat((np.cumsum(count) - count)[which] - np.cumsum(each) + each, each) + np.arange(each.sum())
            seed, s, e, mark = (np.concatenate(x)[row] for x in zip(*table, strict=True))
            at = np.repeat(start, each)
            h = mixed(run_hashes(run_sums(units), at + s, at + e) + mixed(seed.astype(np.uint64)))
            out = np.empty(len(h), ENTRY)
            out["key"], out["index"] = h & np.uint64(0xFFFFFFFF), mark
            out["sig"], out["ref"] = np.repeat(signatures(units, sizes)[chosen], each), np.repeat(refs[chosen], each)
            return ((h >> np.uint64(32)) % np.uint64(deal.count)).astype(np.int32), out

        def entries() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for seen, hashes in (x for batch in batches for x in lines(batch)):
                refs = np.array(hashes, np.uint64).view(np.int64)
                units, sizes = word_hashes(seen)
                # two edits change the number of words by two at most
                short, long = np.flatnonzero(sizes < ONLY_WORDS + 2), np.flatnonzero(sizes >= MIN_WORDS)
                if len(long):
                    yield parts(True, units, sizes, long, refs)
                if len(short):
                    yield parts(False, *characters([seen[i] for i in short]), np.arange(len(short)), refs[short])

        yield from deal.pack(entries())

    return docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(lean(run), SCHEMA)


def candidates(posted: DataFrame, deal: Deal) -> DataFrame:
    """Rows (a, b, gid): pairs of lines that meet under a key and whose entries allow it (gid null), or, for lists longer than
    PAIRWISE, the lines a of the list gid (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, e in deal.buckets(batches):
            # most keys occur once; of the others, lists of one line or without a line's own segment link nothing
            order = np.sort(e["key"].astype(np.uint64) << np.uint64(32) | np.arange(len(e), dtype=np.uint64))
            same = (order[1:] ^ order[:-1]) >> np.uint64(32) == 0
            e = e[(order[np.r_[same, False] | np.r_[False, same]] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            first = np.flatnonzero(np.r_[True, e["key"][1:] != e["key"][:-1]][: len(e)])
            last = np.r_[first[1:], len(e)]
            if len(e):
                many = (np.minimum.reduceat(e["ref"], first) != np.maximum.reduceat(e["ref"], first)) & (np.bitwise_or.reduceat(e["index"], first) & 1 == 1)
                first, last = first[many], last[many]
            left, right, group, member = [], [], [], []
            two = first[last - first == 2]
            x, y = e[two], e[two + 1]
            good = may_link(x, y)
            left.append(x["ref"][good])
            right.append(y["ref"][good])
            for i in np.flatnonzero(last - first > 2):
                one = e[first[i] : last[i]]
                if len(one) <= PAIRWISE:
                    p, q = np.nonzero(np.triu(may_link(one[:, None], one[None, :]), 1))
                    left.append(one["ref"][p])
                    right.append(one["ref"][q])
                else:
                    refs = np.unique(one["ref"])
                    # lists of the same lines, as those of a class of variants, are one
                    name = xxhash.xxh64_intdigest(refs.tobytes()) >> 1
                    group.append(np.full(len(refs), name, np.int64))
                    member.append(refs)
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            n, m = pairs.shape[1], sum(map(len, member))
            columns = [np.concatenate([pairs[0], *member]), np.concatenate([pairs[1], np.zeros(m, np.int64)]), np.concatenate([np.zeros(n, np.int64), *group])]
            none = np.arange(n + m) >= n
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=none), pa.array(columns[2], mask=~none)], names=["a", "b", "gid"])

    return deal.rows(posted).mapInArrow(lean(run), "a long, b long, gid long")


#: Links between lines, each named by both of its hashes (the candidates know one of them).
LINKS = "a struct<a:long,b:long>, b struct<a:long,b:long>"


def names(pairs: list[tuple[tuple[int, int], tuple[int, int]]]) -> pa.RecordBatch:
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array([{"a": p[i][0], "b": p[i][1]} for p in pairs], kind) for i in range(2)], names=["a", "b"])


def pair_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts are near-duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            if good := [((a, a2), (b, b2)) for a, a2, b, b2, x, y in rows if near(x, y)]:
                yield names(good)

    x = texts.select("a", F.col("b").alias("a2"), F.col("line").alias("x"))
    y = texts.select(F.col("a").alias("b"), F.col("b").alias("b2"), F.col("line").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "a2", "b", "b2", "x", "y").mapInArrow(lean(run), LINKS)


def class_links(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Numbers of lines: the first one of each class that the lines' own links make, with each other one of it.

    Sketches rule out nearly all pairs that are too far apart, and pairs that earlier ones connect are skipped, so it takes about one
    comparison of texts a line however many classes there are."""
    units, sizes = word_hashes(lines)
    bags, k_words = sketches(units, sizes), np.array([word_edits(n) for n in sizes.tolist()])
    k_chars = np.array([char_edits(len(x)) for x in lines])
    by_chars = (k_chars > 0) & (sizes < ONLY_WORDS)
    if by_chars.any():
        chars = sketches(*pairs_of(*characters(lines)))
    label = np.arange(len(lines))

    def apart(seen: np.ndarray, u: int) -> np.ndarray:
        return np.bitwise_count(seen[:u] ^ seen[u]).sum(axis=1, dtype=np.int64)

    for u in range(1, len(lines)):
        # an edit changes two bits of the words' sketch, and four of that of neighbouring characters
        far = apart(bags, u)
        k = np.minimum(k_words[:u], k_words[u])
        may = (k > 0) & (far <= 2 * k)
        if by_chars[u] or by_chars[:u].any():
            k = np.minimum(k_chars[:u], k_chars[u])
            may |= (k > 0) & (by_chars[:u] | by_chars[u]) & (apart(chars, u) <= 4 * k)
        open_ = np.flatnonzero(may & (label[:u] != label[u]))
        # the likeliest first: a link makes all of its class needless
        open_ = open_[np.argsort(far[open_], kind="stable")]
        while len(open_):
            v = open_[0]
            if near(lines[v], lines[u]):
                label[label == label[u]] = label[v]
                open_ = open_[1:][label[open_[1:]] != label[u]]
            else:
                open_ = open_[1:]
    first = np.full(len(lines), len(lines))
    np.minimum.at(first, label, np.arange(len(lines)))
    for u, v in enumerate(first[label].tolist()):
        if v != u:
            yield v, u


def grouped_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that connect the lines of long lists as all their links would; members: (gid, a).

    A list is dealt into blocks of about BLOCK lines, and a task compares one pair of blocks. Its classes hang on their first lines, so
    that lists which share a class give the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        for _, group in groupby(rows, key=lambda r: r[:3]):
            held = [r[3:] for r in group]
            if found := [(held[v][:2], held[u][:2]) for v, u in class_links([x for *_, x in held])]:
                yield names(found)

    sizes = members.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "gid").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.select("gid", "a", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "a").join(texts, "a")
    # a number of parts that is given is kept: the lists' cost is more than their bytes tell
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select("gid", "i", "j", "a", "b", "line").repartition(parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j", "a", "b").mapInArrow(lean(run), LINKS)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct line that occurs more than once or has a near-duplicate: a, b (its hashes), doc, text_hash, no (the place
    of its class's first line), near (the class has several distinct lines)."""
    lines = lines_of(docs, id_col, text_col)
    first = lines.groupBy("a", "b").agg(F.min(F.struct("doc", "text_hash", "no")).alias("first"), F.count("*").alias("n"), F.first(F.length("line") >= MIN_CHARS).alias("joined"))
    first = stored(first, "lines")
    deal = Deal(24 * first.where("joined").count(), ENTRY)
    found = stored(candidates(postings(docs, text_col, deal), deal), "line-candidates")
    pairs, members = found.where("gid is null").select("a", "b").distinct(), found.where("gid is not null").select("gid", "a").distinct()
    wanted = stored(pairs.select("a").union(pairs.select("b")).union(members.select("a")).distinct(), "lines-wanted")
    small = wanted.count() <= BROADCAST_LINES
    texts = lines.select("a", "b", "line").join(F.broadcast(wanted) if small else wanted, "a", "left_semi").groupBy("a", "b").agg(F.first("line").alias("line"))
    texts = stored(texts, "line-texts")
    links = pair_links(pairs, texts).union(grouped_links(members, texts))
    parts = components(links)
    parts = parts.unionByName(parts.select(F.col("component").alias("node"), "component")).distinct()
    parts = stored(parts.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "component"), "line-parts")
    named = first.join(parts, ["a", "b"], "left")
    single = named.where("component is null and n > 1").select("a", "b", "first", F.lit(False).alias("near"))
    group = named.where("component is not null").select("a", "b", "first", "component")
    head = group.groupBy("component").agg(F.min("first").alias("first"))
    near = group.drop("first").join(head, "component").select("a", "b", "first", F.lit(True).alias("near"))
    return single.unionByName(near).select("a", "b", "first.doc", "first.text_hash", "first.no", "near")


#: The columns that dedup_lines adds.
ADDED = ("inkwell_lines", "inkwell_exact", "inkwell_near", "inkwell_kept_in")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows and columns with the repeated lines taken out of ``text``, and inkwell_lines, inkwell_exact and inkwell_near: its
    lines, and those removed as exact copies and as near-duplicates; inkwell_kept_in: the documents that keep the first lines of
    their classes, sorted. Where the input has a column of such a name, the added one gets underscores behind it.

    A line (between newlines) that has a word goes unless it is the first of its class, by document id, then text hash, then line
    number; a null id comes first. Blank lines stay; lines below MIN_CHARS characters go as exact copies only. Rows with the same id and
    text are one document: all of them keep or lose the same lines. A null text stays null and has 0 lines; a text that loses all its
    lines becomes empty. Texts and lines of any length are read whole; an empty table gives an empty result. Ids are whole numbers.
    """
    classes = stored(line_classes(docs, id_col, text_col), "line-classes").select("a", "b", F.struct("doc", "text_hash", "no").alias("kept"), "near")
    places = lines_of(docs, id_col, text_col).drop("line").join(classes, ["a", "b"]).where(F.struct("doc", "text_hash", "no") != F.col("kept"))
    # a removed line equal to its class's first line is an exact copy; all others of a class with several lines count as near
    doc, digest, drop, exact, near, kept_in = fresh(docs, "doc", "text_hash", "drop", "exact", "near", "kept_in")
    drops = places.groupBy(F.col("doc").alias(doc), F.col("text_hash").alias(digest)).agg(F.collect_set(F.struct("no", "near", F.col("kept.doc").alias("kept"))).alias("d"))
    n_near = F.size(F.filter("d", lambda x: x.near)).cast("long")
    drops = drops.select(doc, digest, F.transform("d", lambda x: x.no).alias(drop), (F.size("d") - n_near).alias(exact), n_near.alias(near), F.array_sort(F.array_distinct(F.transform("d", lambda x: x.kept))).alias(kept_in))
    # the build side has one row a document, of its line numbers; the hash join spares a sort of all texts
    met = docs.join(drops.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(digest)), "left")

    def left(text: Column) -> Column:
        # the text is split once, not for each line that stays
        kept = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
        return let(F.split(text, "\n", -1), lambda parts: F.array_join(F.transform(kept(parts), lambda i: F.get(parts, i)), "\n"))

    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(left(F.col(text_col)))
    n_lines = F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    counts = [n_lines, F.coalesce(exact, F.lit(0)), F.coalesce(near, F.lit(0)), F.coalesce(kept_in, F.array().cast("array<bigint>"))]
    return met.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), *(x.alias(n) for n, x in zip(fresh(docs, *ADDED), counts, strict=True)))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("inkwell_lines").alias("n_lines"), F.col("inkwell_exact").alias("n_exact"), F.col("inkwell_near").alias("n_near"), F.col("inkwell_kept_in").alias("kept_in"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated lines; n_chars, where there is one, follows the text. Rows and columns, with
    whatever names, stay as dedup_lines says; an empty table stays empty."""
    small_batches(spark)
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
