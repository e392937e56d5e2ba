"""The ten operators on small tables with all the awkward cases, against plain versions; and on the test tables."""

import functools
import operator
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import decontaminate, language_id, line_dedup, lm_scoring, packed, quality_rules, sentencepiece_codec, simhash, suffix_dedup, url_filter, warc
from inkwell.llm.common import components, shared_dir

from . import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
random.seed(11)


def prose(n, letters="abcdefgh"):
    return " ".join("".join(random.choice(letters) for _ in range(random.randint(2, 7))) for _ in range(n))


BASE = [prose(60) for _ in range(6)]
PASSAGE = prose(70)


def change(t):
    w = t.split(" ")
    w[random.randrange(len(w))] = "changed"
    return " ".join(w)


ROWS = [
    (None, BASE[0]), (1, None), (2, ""), (3, "  \n\t "), (4, BASE[1]), (5, BASE[1]), (5, BASE[1]), (6, change(BASE[1])), (7, prose(20) + "\n" + PASSAGE + "\n" + prose(20)), (8, PASSAGE + "\n" + prose(30)),
    (9, "To " * 80), (10, "a" * 300), (11, "a" * 170 + "b"), (12, "Füße 中文 字 ▁ x  y   z ▁\n\nline"), (13, "one"), (14, "ONE"), (15, prose(4000)), (16, "x" * 20000), (17, "é" * 60), (18, "é" * 60 + BASE[2] + "\n" + BASE[2]),
    (None, BASE[0]), (19, "#$% ### *** " * 20), (20, BASE[3] + "\n" + BASE[3].replace("a", "b", 1)), (-4, BASE[3] + "\n" + BASE[4]), (21, BASE[4][:30] + "z" + BASE[4][30:]), (22, "Same line of twenty characters\nSame line of twenty characters\n\nshort\nshort"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns that have names the operators use inside."""
    rows = [(d, t, 1, "x", 2.0, "y", 3) for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, row int, key string, score double, fp string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def expect(found):
    return sorted(map(tuple, found), key=str)


def test_op1_matches_the_library(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for d, t in ROWS:
        ids = sp.encode(t or "", add_eos=True)
        want.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(sp.decode(ids)), ids))
    got = sentencepiece_codec.encode_documents(docs, MODEL, keep=True)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids") == expect(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" ab▁é中\n\t\x00😀</s>", max_size=30), max_size=5))
def test_op1_chunks_of_any_text(texts):
    codec = test_op1_chunks_of_any_text.__dict__.setdefault("codec", sentencepiece_codec.ChunkCodec(MODEL, entries=20))
    for t, (n, ids, text) in zip(texts, codec.encode_batch(texts), strict=True):
        want = codec.sp.encode(t, add_eos=True)
        assert (n, ids, text) == (len(want), " ".join(map(str, want)), codec.sp.decode(want))


FOUND2 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize(("sample", "hot", "buckets"), [(64, 1 << 16, 4096), (1, 2, 4096), (1, 1 << 16, 4)])
def test_op2_matches_brute_force(docs, empty, sample, hot, buckets, monkeypatch):
    """Also with every anchor that has two contexts posted window by window, and with buckets dealt in two steps."""
    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(packed, "DIRECT", buckets)
    assert rows(suffix_dedup.remove_repeats(docs), *FOUND2) == expect(brute.repeats(ROWS))
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("part", [7, 40])
def test_op2_looks_at_texts_in_parts(docs, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    assert rows(suffix_dedup.remove_repeats(docs), *FOUND2) == expect(brute.repeats(ROWS))


def test_op2_after_a_change_of_partitioning(spark, tmp_path):
    """Rows are known by id and content: another split of the files between its jobs and the result's changes nothing."""
    data = [(i, t) for i, (_, t) in enumerate(ROWS) if t] * 3
    spark.createDataFrame(data, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.minPartitionNum", "2")
    try:
        got = suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "d")))
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        assert rows(got, *FOUND2) == expect(brute.repeats(data))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=70))
def test_op2_suffix_order(symbols):
    order = suffix_dedup.suffix_order(np.array(symbols, np.int64))
    assert sorted(order.tolist()) == list(range(len(symbols)))
    assert all(symbols[a : a + 81] <= symbols[b : b + 81] for a, b in zip(order[:-1], order[1:], strict=True))


def test_op3_round_trip(spark):
    body = "b" * 120
    pages = [(4, "http://x/1", body), (2, None, body), (3, "http://x/3\r\nA: b", "short"), (5, "u", "short"), (None, "n", body), (6, "e", None), (7, "é", "é" * 50), (8, "é", "é" * 50), (8, "é", "é" * 50), (7, "é", "é" * 50), (9, "v", "\r\n\r\nWARC/1.1\r\n" * 9)]
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, row int, digest string").repartition(3)
    root = f"{shared_dir(spark)}/warc-test"
    index = warc.write_archives(df, root)
    got = warc.read_records(index, root, bodies=True).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r["id"], []).append((r["record_type"], r["refers_to"]))
    want = {4: ("revisit", 2), 2: ("response", None), 3: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None), 9: ("response", None)}
    assert {k: kinds[k] for k in want} == {k: [v] for k, v in want.items()}
    assert kinds[8] == [("revisit", 7)] * 2 and kinds[7] == [("response", None)] * 2
    text = {p[0]: (p[2] or "") for p in pages}
    for r in got:
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text[r["id"]].encode()), brute.sha(text[r["id"]]))
        assert r["body"] == (text[r["id"]] if r["record_type"] == "response" else None)
    assert warc.read_records(index.where("id = 9"), root).count() == 1
    none = warc.write_archives(df.limit(0), f"{root}-none")
    assert none.count() == 0 and warc.read_records(none, root).count() == 0


def test_op4_prefers_the_target(spark, docs, empty):
    texts = [(i, prose(50, "abcd")) for i in range(30)] + [(100 + i, prose(50, "wxyz")) for i in range(30)] + [(200, None), (201, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in range(20)] + [(None,), (3,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, targets).collect()}
    assert max(got[i]["score"] for i in range(20, 30)) < min(got[100 + i]["score"] for i in range(30))
    assert got[200]["score"] is None and got[201]["n_tokens"] == 0
    assert lm_scoring.cross_entropy_difference(docs, targets).count() == len(ROWS)
    assert lm_scoring.cross_entropy_difference(empty, targets).count() == 0


@pytest.mark.parametrize(("block", "fan"), [(1 << 21, 4096), (4, 4096), (4, 2)])
def test_op4_losses_match_a_plain_model(spark, block, fan, monkeypatch):
    """Counts and smoothing, recomputed with dictionaries; small blocks share keys; a small fan adds them up in steps. All words have equal
    counts or few, and one is long: none is left out."""
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    monkeypatch.setattr(lm_scoring, "FAN", fan)
    texts = [(1, "a b A\tb"), (2, "a b c a b c"), (3, "zz"), (None, "a b"), (4, "b a b a b a " * 5), (5, "a b a b"), (5, "a b a b"), (6, None), (7, " \n"), (8, "x" * 70 + " a"), (9, "É é a")]
    df = spark.createDataFrame([(*x, 1, "y") for x in texts], "doc_id long, text string, block int, wanted string").repartition(3)
    got = rows(lm_scoring.cross_entropy_difference(df, spark.createDataFrame([(1,), (5,), (8,), (None,), (77,)], "doc_id long")), "doc_id", "n_tokens", "target_loss", "background_loss", "score")
    coded = [(d, (t or "").encode().lower().split()) for d, t in texts]

    def loss(train, t):
        grams = [g for x in train for g in zip([None, *x], x, strict=False)]
        low = lambda w: (sum(g[1] == w for g in grams) + lm_scoring.LOW_PRIOR * lm_scoring.UNIFORM) / (len(grams) + lm_scoring.LOW_PRIOR)
        seen = lambda v: sum(v in x[i : i + 1] for x in train for i in range(len(x))) if v else sum(map(bool, train))
        p = lambda v, w: (grams.count((v, w)) + lm_scoring.PRIOR * low(w)) / (seen(v) + lm_scoring.PRIOR)
        return -sum(np.log(p(v, w)) for v, w in zip([None, *t], t, strict=False)) / len(t)

    want = []
    for d, t in coded:
        a, b = (loss([x for i, x in coded if i in (1, 5, 8)], t), loss([x for _, x in coded], t)) if t else (None, None)
        want.append((d, len(t), a, b, a - b if t else None))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == w[:2]
        assert g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-12) if w[2] is not None else g[2:] == w[2:]


def test_op5_matches_brute_force(docs, empty):
    got = rows(quality_rules.measure(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == expect((d, *brute.quality(t)) for d, t in ROWS)
    assert quality_rules.ledger(empty).count() == 0


def test_op5_policies_and_ablations(docs, empty):
    book = quality_rules.apply_policy(quality_rules.ledger(docs), "strict-1").collect()
    report = {r["rule"]: r for r in quality_rules.ablations(quality_rules.ledger(docs), "strict-1").collect()}
    kept = sum(r["kept"] for r in book)
    for rule in quality_rules.RULES:
        b = quality_rules.bit(rule)
        only = sum(r["failures"] == b for r in book)
        assert (report[rule]["n_fail"], report[rule]["n_only"], report[rule]["kept_without"]) == (sum(bool(r["failures"] & b) for r in book), only, kept + only)
        others = [r["failures"] - b for r in book if r["failures"] & b]
        assert report[rule]["with_some"] == functools.reduce(operator.or_, others, 0)
        assert report[rule]["with_all"] == (functools.reduce(operator.and_, others) if others else 0)
    assert all(r["n_fail"] == 0 for r in quality_rules.ablations(quality_rules.ledger(empty), "base-1").collect())


def test_op6_matches_brute_force(docs, empty):
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expect(brute.simhash(ROWS))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("expected", "pairwise"), [(64, 64), (0, 64), (2, 16)])
def test_op6_links_at_every_depth(spark, expected, pairwise, monkeypatch):
    """Short and long lists, posted under one to five positions; clusters that share most bytes and fingerprints far apart."""
    monkeypatch.setattr(simhash, "EXPECTED", expected)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fps = [0, *base.tolist()]
    for x in base[:12].tolist():
        for bits in (1, 2, 3, 3, 3, 4, 5):
            for b in rng.choice(64, bits, replace=False).tolist():
                x ^= 1 << b
            fps.append(x)
    core = int(base[20])
    fps += [core ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 24, (120, 2)) if a != b]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(simhash.signed(int(x)),) for x in fps], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, len(fps)).collect()]
    at = {simhash.signed(int(x)): i for i, x in enumerate(fps)}
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)]
    assert brute.groups(len(fps), [(at[a], at[b]) for a, b in edges]) == brute.groups(len(fps), pairs)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(200, 200), (161, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 162)) and all(got[i] == 7 for i in range(8, 60)) and 200 not in got


def test_op7_learns_and_rejects(spark, docs, empty):
    rows_ = [(i, prose(30, "abcde" if i % 2 else "stuvw"), "xx" if i % 2 else "yy") for i in range(80)] + [(100, None, "xx"), (101, "123 !?", "yy"), (102, "", None), (None, "abc abd", "xx")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    model = language_id.learn(df.where(~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == ("xx" if i % 2 else "yy") and 0 < got[i]["score"] <= 1 for i in range(80))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (100, 101, 102))
    assert language_id.identify(docs, model).count() == len(ROWS)
    assert language_id.learn(empty) == {}
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_op7_binding_is_the_definition():
    space = language_id.Space(64)
    a, b, c = (space.letter(ord(x)).astype(int) for x in "abc")
    code = (ord("a") << 42) | (ord("b") << 21) | ord("c")
    assert (space.gram(code) == np.roll(a, 2) * np.roll(b, 1) * c).all()
    codes, counts = space.grams("Abc, abc")
    assert (space.bundle(codes, counts) == sum(n * space.gram(int(x)).astype(int) for x, n in zip(codes, counts, strict=True))).all()


def test_op7_query_matches_plain_prototypes(spark):
    """Every row of the query against prototypes and cosines built one letter at a time from the definition."""
    table = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = brute.languages(table, language_id.Space().letter)
    got = {r["doc_id"]: r for r in language_id.op7_language_id(spark, SF).collect()}
    assert set(got) == set(want)
    for d, (held, lang, score) in want.items():
        assert (got[d]["held_out"], got[d]["lang_pred"]) == (held, lang), d
        assert got[d]["score"] == pytest.approx(score, abs=1e-9), d


def test_op7_stage_keeps_columns_and_takes_any_name(spark, empty):
    rows_ = [(i, prose(30, "abcde" if i % 2 else "stuvw"), "xx" if i % 2 else "yy", i, "t") for i in range(40)] + [(50, None, "xx", 50, "t"), (51, "12", None, 51, "t"), (52, "", "yy", 52, "t")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, score_found int, TEXT_READ string")
    out = language_id.stage(spark, df, SF)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == rows_[:40]
    assert language_id.stage(spark, empty, SF).count() == 0


def test_op7_held_out_accuracy(spark):
    got = language_id.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out AND n_chars > 100").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


ITEMS = [(1, PASSAGE), (2, " ".join(BASE[1].split()[5:25])), (None, "one"), (3, None), (4, "..."), (2, " ".join(BASE[1].split()[5:25])), (5, "nowhere to be found in any of the texts here at all my friend truly")]


@pytest.mark.parametrize("sent", [0, 1000])
def test_op8_matches_brute_force(spark, docs, empty, sent, monkeypatch):
    """With the index of the tests' terms and with that of all terms."""
    monkeypatch.setattr(decontaminate, "SENT_TERMS", sent)
    tests = spark.createDataFrame([(*i, 0, "w") for i in ITEMS], "item_id long, text string, key int, name string")
    got = decontaminate.contamination(docs, tests)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expect(brute.contamination(ROWS, ITEMS))
    assert decontaminate.contamination(empty, tests).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, tests.limit(0)).collect()} == {0}


def test_op8_shared_passages(spark):
    """Tests that occur in many documents, and one that lies across two of their passages."""
    texts = [prose(30, "abc") for _ in range(6)]
    data = [(i, " ".join(random.choice(texts) for _ in range(3))) for i in range(60)]
    items = [(i, " ".join(t.split()[random.randint(0, 5) :])) for i, t in enumerate(texts)] + [(9, " ".join(texts[0].split()[-8:] + texts[1].split()[:8]))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expect(brute.contamination(data, items))


def test_op8_proximity(spark):
    tests = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(1, "delta x x gamma x beta x alpha"), (2, "alpha " + "x " * 90 + "beta gamma delta"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_near"], r["n_items"]) for r in decontaminate.contamination(df, tests).collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (1, 1)}


def plain_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = brute.low(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


@pytest.mark.parametrize("broadcast", [0, 100])
@pytest.mark.parametrize("lengths", [1, 64])
def test_op9_matches_plain_rules(spark, broadcast, lengths, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    monkeypatch.setattr(url_filter, "PATH_LENGTHS", lengths)
    urls = ["http://a.com/", "https://WWW.Example.com/en/x?q", "http://example.com/en/", "http://x.example.com/en/a/b#c", "http://example.com/enx", "http://net/es/1", "http://b.net/fr/", None, "no scheme", "", "http://", "http://notexample.com/en/", "http://b.net", "ftp://q.net/es/http://z.com/", "http://c.com?x=/", "http://a.com/"]
    rules = [*url_filter.RULES, ("org", "", "block"), ("a.com", "/", "block"), ("a.com", "/", "allow"), ("com", "/", "allow")]
    df = spark.createDataFrame([(i if i != 3 else None, u, 1) for i, u in enumerate(urls)], "page_id long, url string, row int")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("x.com", None, "block")], "host string, path string, verdict string")
    want = [(i if i != 3 else None, *plain_judge(u, rules)) for i, u in enumerate(urls)]
    assert rows(url_filter.judge(df, table), "page_id", "host", "path", "rule", "verdict") == expect(want)
    assert url_filter.judge(df.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, table.limit(0)).collect()} == {"allow"}


def test_op9_empty_tables_nulls_and_long_urls(spark):
    urls = spark.createDataFrame([(1, None), (None, "http://A.com/x"), (2, "http://b.com/" + "x" * 100_000), (2, "nothing")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    got = rows(url_filter.judge(urls, rules.limit(0)), "page_id", "host", "rule", "verdict")
    assert got == expect([(1, "", None, "allow"), (None, "a.com", None, "allow"), (2, "b.com", None, "allow"), (2, "", None, "allow")])
    assert rows(url_filter.judge(urls, rules), "page_id", "verdict") == expect([(1, "allow"), (None, "block"), (2, "block"), (2, "allow")])
    assert url_filter.judge(urls.limit(0), rules).count() == 0


def test_op3_empty_index(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}")
    assert index.count() == 0 and warc.read_records(index, f"file://{tmp_path}").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=14), st.text("ab", max_size=14), st.integers(1, 3))
def test_op10_distance(a, b, k):
    assert line_dedup.within(a, b, k) == (brute.distance(a, b) <= k)


def found_lines(df):
    return rows(df, "doc_id", "inkwell_lines", "inkwell_exact", "inkwell_near", "sha")


def test_op10_matches_brute_force(docs, empty):
    from pyspark.sql import functions as F

    got = line_dedup.dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert found_lines(got.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))) == expect(brute.line_dedup(ROWS))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_op10_edited_lines(spark):
    """Lines of all lengths with more and fewer edits than allowed; characters of several bytes; repeated text; short exact copies."""
    from pyspark.sql import functions as F

    def edited(x, n):
        x = list(x)
        for _ in range(n):
            i = random.randrange(len(x))
            x[i : i + 1] = random.choice([["#"], [], [x[i], "é"]])
        return "".join(x)

    lines = []
    for size in (8, 9, 10, 11, 19, 20, 22, 60, 185, 400, 700):
        base = (prose(400, "abcdefghij" if size % 4 else "éaü中bcd") + "x" * size)[:size]
        lines += [base, *(edited(base, n) for n in (1, 2, 2, 3, 4))]
    for size in (9, 10, 18, 19, 20, 21, 22, 23, 39, 41, 80, 200, 330):
        base = [prose(1) + str(i) for i in range(size)]
        for n in (0, 1, 1, 2, 3, 4, 5):
            w = list(base)
            for _ in range(n):
                i = random.randrange(len(w))
                w[i : i + 1] = random.choice([["another"], [], [w[i], "füße", "more"][: random.randint(1, 3)]])
            lines.append(" ".join(w))
    lines += ["ab " * 100, "ab " * 100 + "c", "ab " * 102, "ab " * 120, "z" * 300, "z" * 304, "z" * 305, "z" * 330]
    data = list(enumerate(lines)) + [(500, "menu\nmenu\n\nmenu"), (501, "menu\nmenus\n")]
    random.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).withColumn("sha", F.sha2("text", 256))
    assert found_lines(got) == expect(brute.line_dedup(data))


def test_op10_short_lines_and_single_words(spark):
    long = [prose(1) + str(i) for i in range(200)]
    texts = ["nineteen characters", "nineteen charakters", " ".join(long), " ".join([*long[:90], "replaced", *long[91:]]), "tiny line", "tiny lime"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows(got, "doc_id", "inkwell_near") == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 0)]


def test_op10_names_that_clash(spark):
    taken = "doc text_hash drop exact near kept_in inkwell_lines inkwell_exact inkwell_near inkwell_kept_in line no a b d n size first component".split()
    df = spark.createDataFrame([(1, "same\nline", *range(len(taken))), (2, "line\nother", *range(len(taken)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in taken))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[2]["text"] == "other" and got[2]["inkwell_exact_"] == 1 and got[2]["inkwell_exact"] == taken.index("inkwell_exact")


def test_op10_long_lists_compare_few_texts(monkeypatch):
    """Lines of a long list in many classes: most differ in a few words more than may be edited. Their classes are those of all
    pairs, with about one comparison of texts a line."""
    words = [prose(1) + str(i) for i in range(90)]
    changed = lambda at: " ".join(f"{w}x{at[i]}" if i in at else w for i, w in enumerate(words))
    lines = [changed({5 * j: random.randrange(40) for j in range(1, 9)}) for _ in range(90)]
    lines += [x.replace(words[0], "first") for x in lines[:30]] + [prose(4) + " " + "y" * n for n in range(12)] + ["short line of words", "short lime of word"]
    random.shuffle(lines)
    calls, near = [], line_dedup.near
    monkeypatch.setattr(line_dedup, "near", lambda x, y: calls.append(x) or near(x, y))
    links = list(line_dedup.class_links(lines))
    want = [(i, j) for i in range(len(lines)) for j in range(i) if brute.near_lines(lines[i], lines[j])]
    numbered = lambda part: [part.index(x) for x in part]
    assert len(want) >= 30 and numbered(list(brute.groups(len(lines), links))) == numbered(list(brute.groups(len(lines), want)))
    assert len(links) <= len(calls) <= 2 * len(lines)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é\t", max_size=60), min_size=1, max_size=6))
def test_op10_hashes_of_runs(lines):
    """Words are those of words_of, and runs of the same units have the same hash wherever they stand; others have another."""
    units, sizes = line_dedup.word_hashes(lines)
    split = [x.encode().split() for x in lines]
    assert sizes.tolist() == list(map(len, split))
    flat = [w for x in split for w in x]
    sums, seen = line_dedup.run_sums(units), {}
    for i in range(len(flat)):
        for j in range(i + 1, len(flat) + 1):
            h = int(line_dedup.run_hashes(sums, np.array([i]), np.array([j]))[0])
            assert seen.setdefault(h, flat[i:j]) == flat[i:j]
    assert len(seen) == len({tuple(x) for x in seen.values()})


def test_op10_groups_of_variants(spark, tmp_path):
    """Hundreds of variants of one line, which go through the grouped comparison, dealt into several blocks."""
    from pyspark.sql import functions as F

    base, words = prose(16), [prose(1) + str(i) for i in range(60)]
    variants = [base[:i] + c + base[i + 1 :] for i in range(0, len(base), 2) for c in "#@%"]
    # of words: the first half stays, so these meet in one list, and they are apart by up to four words
    longer = [" ".join([*words[:40], f"{i}x", *words[41:50], *(["more"] if i % 3 else []), f"{i % 5}y", *words[51 + i % 2 :]]) for i in range(100)]
    data = list(enumerate(variants + longer + [prose(8) for _ in range(30)]))
    df = spark.createDataFrame(data, "doc_id long, text string")
    deal = line_dedup.Deal(1000, line_dedup.ENTRY)
    lists = line_dedup.candidates(line_dedup.postings(df, "text", deal), deal).where("gid IS NOT NULL").groupBy("gid").count().collect()
    assert len([r for r in lists if r["count"] > line_dedup.PAIRWISE]) >= 2
    block, line_dedup.BLOCK = line_dedup.BLOCK, 20
    try:
        got = line_dedup.dedup_lines(df).withColumn("sha", F.sha2("text", 256))
        assert found_lines(got) == expect(brute.line_dedup(data))
    finally:
        line_dedup.BLOCK = block
