"""Plain single-process versions of the operators, for tests."""

import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash

BLANKS = " \t\n\x0b\x0c\r"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def groups(n, linked):
    """Smallest member of each of n nodes' component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def repeats(rows, size=50):
    """rows: (doc, text); result rows like operator 2. A null doc is smaller than all others."""
    key = lambda d: -(1 << 62) if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            first[w] = min(first.get(w, 1 << 62), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < key(d):
                m[i : i + size] = b"\1" * size
        spans = sum(m[i] and (i == 0 or not m[i - 1]) for i in range(len(m)))
        out.append((d, len(b), sum(m), spans, sha(bytes(c for c, k in zip(b, m, strict=True) if not k))))
    return out


def quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def simhash(rows):
    f = np.array([fingerprint(t) for _, t in rows], np.uint64)
    pairs = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3)]
    part = groups(len(rows), pairs)
    least = collections.defaultdict(list)
    for p, (d, _) in zip(part, rows, strict=True):
        if d is not None:
            least[p].append(d)
    return [(d, f"{int(x):016x}", min(least[p], default=None)) for (d, _), x, p in zip(rows, f, part, strict=True)]


def contamination(rows, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = collections.defaultdict(set)
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add("null" if name is None else str(name))
    out = []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if of := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= of
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


def near_lines(a, b):
    """With under 20 words: one edit from 10 characters on, two from 20. Of words: one from 10 words on, one more for each doubling."""
    v, w = re.findall(r"[^\x20\x09-\x0D]+", a), re.findall(r"[^\x20\x09-\x0D]+", b)
    n = min(len(a), len(b))
    k = 0 if n < 10 else 1 if n < 20 else 2
    if min(len(v), len(w)) < 20 and k and abs(len(a) - len(b)) <= k and near(a, b, k):
        return True
    n, k = min(len(v), len(w)), 0
    while n >= 10 * 2**k:
        k += 1
    return k > 0 and abs(len(v) - len(w)) <= k and near(v, w, k)


def line_dedup(rows):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    key = lambda d, t, n: ((d is not None, d or 0), signed(xxhash.xxh64_intdigest(t.encode(), 42)), n)
    places = collections.defaultdict(set)
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n") if t is not None else []):
            if x.strip(BLANKS):
                places[x].add(key(d, t, n))
    lines = list(places)
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if near_lines(lines[i], lines[j])]
    part = dict(zip(lines, groups(len(lines), pairs), strict=True))
    first, size = {}, collections.Counter(part.values())
    for x in lines:
        first[part[x]] = min(min(places[x]), first.get(part[x], ((True, 1 << 62), 0, 0)))
    out = []
    for d, t in rows:
        kept, exact, close = [], 0, 0
        for n, x in enumerate(t.split("\n") if t is not None else []):
            if x in part and first[part[x]] != key(d, t, n):
                exact, close = (exact, close + 1) if size[part[x]] > 1 else (exact + 1, close)
            else:
                kept.append(x)
        out.append((d, len(t.split("\n")) if t is not None else 0, exact, close, sha("\n".join(kept))))
    return out


def near(a, b, k):
    """Whether the distance is at most k, from the characters' counts where these rule it out."""
    x, y = collections.Counter(a), collections.Counter(b)
    return sum((x - y).values()) <= k and sum((y - x).values()) <= k and distance(a, b) <= k


def jaccard_groups(rows, size=5):
    """Smallest id of each row's component over pairs whose sets of shingles have a similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    part = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    least = collections.defaultdict(list)
    for p, (d, _) in zip(part, rows, strict=True):
        if d is not None:
            least[p].append(d)
    return [(d, min(least[p], default=None)) for (d, _), p in zip(rows, part, strict=True)]


def languages(rows, letter):
    """By document id: held out, predicted language, cosine. ``letter`` gives a code point's fixed vector; everything else is done here
    one n-gram at a time."""
    vectors = {}

    def gram(g):
        if g not in vectors:
            vectors[g] = np.roll(letter(ord(g[0])).astype(int), 2) * np.roll(letter(ord(g[1])).astype(int), 1) * letter(ord(g[2])).astype(int)
        return vectors[g]

    def bundle(text):
        spaced = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")) + " "
        spaced = re.sub(" +", " ", spaced)
        out = np.zeros(len(letter(97)), int)
        for g, n in collections.Counter(spaced[i : i + 3] for i in range(len(spaced) - 2)).items():
            out += n * gram(g)
        return out

    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    bundles = {d: bundle(t) for d, t, _ in rows}
    prototypes = {}
    for d, t, lang in rows:
        if not held[d] and t is not None and lang is not None:
            prototypes[lang] = prototypes.get(lang, 0) + bundles[d]
    out = {}
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            out[d] = held[d], "und", 0.0
            continue
        v = bundles[d]
        cos = {k: round(float(v @ p) / float(np.linalg.norm(v) * np.linalg.norm(p)), 12) for k, p in prototypes.items()}
        best = min(cos, key=lambda k: (-cos[k], k))
        out[d] = held[d], best, min(1.0, max(0.0, cos[best]))
    return out


def all_runs(w, least=12):
    """(start, length, smallest period) of the runs of a list, period after period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def seeded_words(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if w and h is not None and h % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


SECRETS = [
    ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def base_secrets(text):
    """(start, rank, end, secret) of the base spans."""
    found = []
    for rank, (_, pattern, group, least) in enumerate(SECRETS):
        found += [(m.start(), rank, m.end(), m[group]) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(found)


def features(text, longest=3):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(rows, target, share=5, least_words=20):
    """rows: (doc, text); (doc, n_features, weight, score, rank) of each."""
    import math

    each = [(d, *features(t)) for d, t in rows]
    s = collections.Counter(zlib.crc32(f.encode()) % 10000 for _, _, fs in each for f in fs)
    t = collections.Counter(zlib.crc32(f.encode()) % 10000 for x in target for f in features(x)[1])
    n_s, n_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * n_s) / float((s[b] + 1) * n_t))) for b in range(10000)]
    out = []
    for d, n, fs in each:
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = drawn[: share * len(drawn) // 100]
    rank = {id(x): k + 1 for k, x in enumerate(drawn)}
    return [(d, f, w, sc, rank.get(id(x))) for x in out for d, _, f, w, sc in [x]]
