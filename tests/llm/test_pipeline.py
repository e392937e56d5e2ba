"""The pipeline's stages one by one against plain versions of their decisions, and its contract."""

import corpus_pipeline
import public_tokenizers
import sentencepiece

from inkwell.llm.common import stored, table

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        pairs = [(d, r["text"]) for d, r in before.items()]
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "language_id":
            gone = set(before) - set(after)
            assert all(len((before[d]["text"] or "").split()) < 20 for d in gone) and all(after[d] == before[d] for d in after)
        elif name == "line_dedup":
            want = {d: s for d, _, _, _, s in brute.line_dedup(pairs)}
            assert {d: brute.sha(r["text"]) for d, r in after.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "simhash_dedup":
            assert set(after) == {d for d, c in brute.jaccard_groups(pairs) if c == d}
        elif name == "decontaminate":
            assert set(after) == {x[0] for x in brute.contamination(pairs, items) if not x[-1]}
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {d: r["ids"] for d, r in after.items()} == {d: sp.encode(t or "", add_eos=True) for d, t in pairs}


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_stages_with_clashing_columns(spark):
    """Null ids and texts, repeated rows, and columns that have the names of the operators' own."""
    names = "doc_id text lang source n_chars score lang_pred row key id fp node a b line".split()
    rows = [(d, t, "en", "s", len(t or ""), 0.5, "x", 1, 2, 3, 4, 5, 6, 7, "l") for d, t in [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (None, None), (None, "zeta eta theta iota kappa"), (2, ""), (3, "lambda mu nu xi omicron pi rho")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, row int, key int, id int, fp int, node int, a int, b int, line string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        if name != "sentencepiece":
            assert docs.columns == names
    assert docs.count() >= 3
