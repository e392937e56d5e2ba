"""Operator 7: language identification with hyperdimensional profiles.

Every letter has a fixed random vector of -1 and 1; an n-gram's vector binds (multiplies) its letters' vectors, each permuted (rotated)
by its place; a text's vector bundles (adds) the vectors of its n-grams, and a language's prototype those of its texts. A text
gets the language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, small_batches, table

DIMENSIONS = 1024
GRAM = 3
SEED = 7
#: n-gram vectors a task keeps (one byte a dimension); at the limit it starts anew, which changes no result.
KEPT_GRAMS = 1 << 16
#: n-gram vectors that are added at a time, and texts whose n-grams a task learns from together.
PART, TEXTS = 1 << 11, 256
#: Prototypes go to the driver and to every task; more languages than this are an error.
MAX_LANGUAGES = 2000
UNDETERMINED = "und"


class Space:
    """Letter vectors, n-gram vectors and bundles."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.d, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.forget()

    def forget(self) -> None:
        self.codes, self.vectors = np.empty(0, np.uint64), np.empty((0, self.d), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.Generator(np.random.PCG64([self.seed, c])).integers(0, 2, self.d, np.int8) * np.int8(2) - np.int8(1)
        return self.letters[c]

    def gram(self, code: int) -> np.ndarray:
        out = np.ones(self.d, np.int8)
        for k in range(GRAM):
            out *= np.roll(self.letter((code >> (21 * k)) & 0x1FFFFF), k)
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the lower-cased text and their counts; what isn't a letter counts as one space between words."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(self.is_letter[c], c, 32)
        c = np.concatenate(([32], c, [32])).astype(np.uint64)
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
        if len(c) < GRAM:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        n = len(c) - GRAM + 1
        code = np.zeros(n, np.uint64)
        for k in range(GRAM):
            code = (code << np.uint64(21)) | c[k : k + n]
        return np.unique(code, return_counts=True)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors; exact, as all sums are whole numbers below 2^53."""
        at = np.searchsorted(self.codes, codes)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == codes) if len(self.codes) else np.zeros(len(codes), bool)
        if not known.all():
            new = codes[~known]
            if len(self.codes) + len(new) > KEPT_GRAMS:
                self.forget()
                new = codes
            out = np.zeros(self.d)
            for part in range(0, max(0, len(new) - KEPT_GRAMS), KEPT_GRAMS):  # a text with more distinct n-grams than are kept
                for code, n in zip(new[part : part + KEPT_GRAMS], counts[part : part + KEPT_GRAMS], strict=True):
                    out += int(n) * self.gram(int(code)).astype(np.float64)
            done = len(range(0, max(0, len(new) - KEPT_GRAMS), KEPT_GRAMS)) * KEPT_GRAMS
            new = new[done:]
            order = np.argsort(both := np.concatenate((self.codes, new)), kind="stable")
            self.vectors = np.concatenate((self.vectors, np.array([self.gram(int(x)) for x in new], np.int8).reshape(-1, self.d)))[order]
            self.codes = both[order]
            if done:
                return out + self.bundle(codes[done:], counts[done:])
            at = np.searchsorted(self.codes, codes)
        out, kind = np.zeros(self.d), np.float32 if counts.sum() < 1 << 22 else np.float64
        for i in range(0, len(at), PART):  # part by part: as floats all vectors would be four to eight times as large
            out += counts[i : i + PART].astype(kind) @ self.vectors[at[i : i + PART]].astype(kind)
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language from all rows with a text and a language.

    Each task adds up the n-gram counts of its rows by language and bundles them into one vector a language; Spark adds these by
    (language, dimension). The driver gets dimensions x languages sums, whatever the size of the corpus. Repeated rows count each; an
    empty table, or one without labels, gives no prototypes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions), {}
        for batch in batches:
            texts: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(i)
            for lang, places in ((k, v[i : i + TEXTS]) for k, v in texts.items() for i in range(0, len(v), TEXTS)):
                found = [space.grams(batch.column(0)[i].as_py()) for i in places]
                codes, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                if len(codes):
                    counts = np.bincount(inverse, np.concatenate([f[1] for f in found]), len(codes))
                    sums[lang] = sums.get(lang, 0) + space.bundle(codes, counts).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(lean(run), "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.limit(MAX_LANGUAGES * dimensions + 1).collect()
    if len(rows) > MAX_LANGUAGES * dimensions:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return {k: out[k] for k in sorted(out)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """One row per document: the id, the columns named in ``keep``, lang_pred, score (cosine with the best prototype, 0 at least); ``names``
    gives the last two other names, for inputs that have such columns.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. Of equal cosines the first language
    by name wins. Only the text is looked at. Repeated rows, null ids and very long texts are rows like any other; columns that ``keep`` doesn't
    name are left out, whatever their names, and an empty table gives none.
    """
    languages = list(prototypes)
    matrix = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in languages]) if languages else np.empty((0, DIMENSIONS))
    dimensions = matrix.shape[1]
    kept = docs.select(id_col, *keep, text_col)
    schema = kept.drop(text_col).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                codes, counts = space.grams(text.as_py() or "")
                best, score = UNDETERMINED, 0.0
                if len(codes) and languages:
                    v = space.bundle(codes, counts).astype(np.float64)
                    cos = np.round(matrix @ v / (np.linalg.norm(v) or 1), 12)
                    best, score = languages[int(cos.argmax())], min(1.0, max(0.0, float(cos.max())))
                langs.append(best)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return kept.mapInArrow(lean(run), schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document is rejected if it is undetermined or no language's profile fits it this well.
MIN_SCORE = 0.05


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: learns from the documents' own labels outside the held-out fold and keeps what has a language.

    Null, empty and letterless texts go; repeated rows and null ids are judged like any other; an empty table stays empty. Other columns
    come through unchanged, whatever their names."""
    small_batches(spark)
    prototypes = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    columns = docs.columns
    text, lang, score = fresh(docs, "text_read", "lang_found", "score_found")
    judged = identify(docs.withColumn(text, F.col("text")), prototypes, text_col=text, keep=tuple(c for c in columns if c != "doc_id"), names=(lang, score))
    return judged.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= MIN_SCORE)).select(*columns)
