"""Operators 11 to 13 against plain versions, on small tables with all the awkward cases."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import importance_resampling, periodic_runs, secret_scan

from . import brute

SF = "/root/testdata/sf0.001"
random.seed(5)


def noise(n):
    return " ".join(random.choice("ab cd ef gh ij kl mn Füße 中文 😀".split()) for _ in range(n))


HEX, KEY, OPAQUE = "0123456789abcdef" * 2, "AKIA" + "Z9" * 8, "aB3dE5gH7jK9mN1pQ3sT5"
ROWS = [
    (None, noise(40)), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b " * 30), (5, "a b " * 30), (6, "a a b " * 50 + noise(30) + " " + "x y z " * 9), (7, noise(3000)), (8, "To " * 11), (9, "To " * 12),
    (10, f'é😀 Token = "abcdef12" {KEY} {HEX}x password:"abc" passwd=\'abcdefg\''), (11, f"{OPAQUE} {HEX}"), (12, f"secret: token: abcdefgh https://u.x:pa$$word1@h/ {KEY}"), (13, f"API_KEY={HEX};apikey:{HEX[:5]}"), (14, "ſecret=abcdefg toKen=abcdefg"),
    (None, "token=" + "x" * 50), (15, "token=abcdef " * 700), (16, noise(25) + " " + noise(25)), (17, " ".join(map(str, range(60))) + " " + " ".join(map(str, range(60)))), (18, "A" * 3000), (-3, "ghp_" + "aB3" * 12), (19, "ghp_" + "aB3" * 12), (20, "ghp_" + "aB3" * 12),
]
ROWS += [(100 + i, noise(30) + f" word{i}") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns that have names the operators use inside."""
    rows = [(d, t, f"src{i % 30}", None if i % 3 else "en", 1, "x", 2.0, "y", 3) for i, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rank int, spans string, score double, id string, owner int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@st.composite
def repetitive(draw):
    w = draw(st.lists(st.integers(0, draw(st.integers(0, 3))), max_size=60))
    for _ in range(draw(st.integers(0, 3))):
        if len(w) > 2:
            s = draw(st.integers(0, len(w) - 2))
            p, e = draw(st.integers(1, len(w) - s)), draw(st.integers(s, len(w)))
            for i in range(s, e):
                w[i] = w[s + (i - s) % p]
    return w


@settings(max_examples=300, deadline=None)
@given(repetitive(), st.sampled_from([2, 3, 5, 12]))
def test_runs(w, least):
    expected = brute.all_runs(w, least)
    assert [(s, e - s, q) for s, e, q in periodic_runs.runs(w, least)] == expected
    assert [(s, e - s, q) for s, e, q in periodic_runs.runs_of_words([str(x).encode() for x in w], least)] == expected


def test_runs_of_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert [(s, e - s, q) for s, e, q in periodic_runs.runs(b, 2)] == brute.all_runs(b, 2)


@pytest.mark.parametrize("w", [[0] * 500, [0, 1] * 400, [*range(300)] * 3, [*range(100), *range(90), *range(100)], [1, *[0] * 40, 2, *[0] * 40, 1, *[0] * 40, 2, *[0] * 40]])
def test_factors_cover_and_occur_before(w):
    at = 0
    for start, size, earlier in periodic_runs.factors(w):
        assert start == at and size > 0 and earlier < start
        if earlier >= 0:
            assert w[earlier : earlier + size] == w[start : start + size]
        else:
            assert size == 1 and w[start] not in w[:start]
        at += size
    assert at == len(w)
    assert [(s, e - s, q) for s, e, q in periodic_runs.runs(w)] == brute.all_runs(w)


def test_periodic_runs(docs, empty):
    got = rows(periodic_runs.periodic_runs(docs), "doc_id", "n_words", "runs", "collapsed")
    expected = []
    for d, t in ROWS:
        w = (t or "").encode().split()
        found = brute.all_runs(w)
        text = brute.collapsed([x.decode() for x in w], found)
        expected.append((d, len(w), found, text))
    assert [(d, n, [tuple(r) for r in found], text) for d, n, found, text in got] == sorted(expected, key=str)
    assert periodic_runs.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError, match="two words"):
        periodic_runs.periodic_runs(docs, least=1)


def test_op11_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    n_seeded = 0
    for d, t in docs:
        w = brute.seeded_words(d, t)
        found = brute.all_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == brute.sha(brute.collapsed(w, found))
        n_seeded += bool(found)
    assert n_seeded > 10


def test_base_secrets(docs, empty):
    got = rows(secret_scan.scan(docs), "doc_id", "spans")
    plain = [(d, [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"], s["hash"]) for s in spans if s["base"]]) for d, spans in got]
    expected = [(d, [(a, k, b, brute.sha(x)) for a, k, b, x in brute.base_secrets(t)]) for d, t in ROWS]
    assert sorted(plain, key=str) == sorted(expected, key=str)
    assert secret_scan.scan(empty).collect() == []


def test_added_secrets_by_owners(docs):
    added = {}
    for d, spans in rows(secret_scan.scan(docs), "doc_id", "spans"):
        added.setdefault(d, []).extend((s["kind"], s["n_owners"]) for s in spans if not s["base"])
    assert added[11] == [("opaque", 1)] and added[12] == [("login", 1)]
    assert added[-3] == added[19] == added[20] == []
    more = {d: spans for d, spans in rows(secret_scan.scan(docs, owners=3), "doc_id", "spans") if d in (-3, 19, 20)}
    assert all([(s["kind"], s["start"], s["end"], s["n_owners"], s["live"]) for s in x] == [("provider", 0, 40, 3, True)] for x in more.values())


def test_ownership_counts(spark):
    secret = "token=abcdefgh"
    given = [(1, secret, "o1", "a"), (2, secret, "o1", "a"), (3, secret, "o1", "b"), (4, secret, "o2", "a"), (5, secret, None, None), (6, "password: abcdefgh, secret=other12", "o3", "a")]
    df = spark.createDataFrame(given, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: [(s.n_spans, s.n_repos, s.n_owners, s.live) for s in r.spans] for r in secret_scan.scan(df, owners=3).collect()}
    assert got[1] == [(6, 5, 4, False)] and got[6] == [(6, 5, 4, False), (1, 1, 1, True)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    got = spark.range(1).select(secret_scan.running(secret_scan.F.lit([3] * n).cast("array<bigint>")).alias("s")).first().s
    assert got == [3 * i for i in range(n)]


def test_resample(docs, empty, spark):
    target = spark.createDataFrame([("ab cd ef gh",), (None,), ("",), ("word3 Füße",)], "text string")
    own = ("doc_id", "n_features", "weight", "score", "rank")
    expected = brute.resampled(ROWS, ["ab cd ef gh", None, "", "word3 Füße"])
    got = rows(importance_resampling.resample(docs, target), *own)
    assert [r[:4] for r in got] == sorted((r[:4] for r in expected), key=str) and sorted(got, key=str) == sorted(expected, key=str)
    assert max(r[4] or 0 for r in got) >= 2
    many = rows(importance_resampling.resample(docs, target, share=100), *own)
    assert sorted(many, key=str) == sorted(brute.resampled(ROWS, ["ab cd ef gh", None, "", "word3 Füße"], share=100), key=str)
    assert importance_resampling.resample(empty, target).collect() == []
    assert rows(importance_resampling.resample(docs, empty.select("text")), *own) == sorted(brute.resampled(ROWS, []), key=str)


def test_blocks_and_dictionaries_change_nothing():
    words, texts = importance_resampling.Words(), [(t or "").encode().translate(importance_resampling.LETTERS).split() for _, t in ROWS]
    whole, counts = importance_resampling.buckets_of(words, texts, 10000)
    parts = [importance_resampling.buckets_of(importance_resampling.Words(), [t], 10000) for t in texts]
    assert whole.tolist() == [x for p, _ in parts for x in p.tolist()] and counts.tolist() == [n for _, c in parts for n in c.tolist()]
    one = whole[: counts[0]].tolist()
    assert sorted(one) == sorted(zlib.crc32(f.encode()) % 10000 for f in brute.features(ROWS[0][1])[1])
