"""Operator 1: SentencePiece encoding and decoding through a distinct-chunk table.

The model marks each space with U+2581 and puts one mark before the text. No piece of a suitable model has a mark
behind another character (checked when the model is loaded), so a merge never crosses the start of a run of marks, and the
marked text falls into chunks (a run of marks and what follows up to the next run) that are segmented independently.
Each task keeps a table of the distinct chunks it has met, segments each once, and joins the ids back by position.
The table is per task, and is emptied at TABLE_ENTRIES, which bounds memory; no row is shuffled. A table of the whole corpus
would have to be joined back to every word (the vocabulary of invented or multilingual text keeps growing, so it can't
be broadcast), which moves several times the input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches, table

#: Distinct chunks a task holds at once; at the limit it starts anew (results do not depend on it).
TABLE_ENTRIES = 1_000_000
#: Texts whose new chunks are segmented in one call.
BATCH_ROWS = 256
MARK = "▁"
CHUNK = re.compile(" +[^ ]*")


class ChunkCodec:
    """ids and decoded text of a text, by chunks. A chunk's key is the chunk without its first mark."""

    def __init__(self, model_path: str, add_eos: bool = True, entries: int = TABLE_ENTRIES):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if any(re.search(f"[^{MARK}]{MARK}", self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())):
            raise ValueError("a piece of this model has a space mark behind another character; its chunks are not independent")
        self.entries, self.eos = entries, [self.sp.eos_id()] if add_eos else []
        self.lone = self.sp.piece_to_id(MARK)
        self.ids: dict[str, str] = {}  # key: decimal ids joined by a space
        self.odd: dict[str, str] = {}  # key: decoded text, where that isn't the key itself

    def keys(self, text: str) -> list[str]:
        """The keys of a text's chunks in order: the parts between single spaces, further spaces staying with the chunk."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [c[1:] for c in CHUNK.findall(" " + text)]

    def learn(self, keys: set[str]) -> None:
        """Segments and decodes the keys that are not yet in the table."""
        new = list(keys.difference(self.ids))
        if len(self.ids) + len(new) > self.entries:
            self.ids, self.odd, new = {}, {}, list(keys)
        ids = [x if k else [self.lone] for k, x in zip(new, self.sp.encode(new, num_threads=1), strict=True)]
        texts = self.sp.decode(ids, num_threads=1) if ids else []
        self.ids.update(zip(new, [str(x)[1:-1].replace(",", "") for x in ids], strict=True))
        self.odd.update((k, t) for k, t in zip(new, texts, strict=True) if k != t)

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, the decimal ids joined by a space, the decoded text."""
        keyed = [self.keys(x) for x in texts]
        self.learn(set().union(*keyed))
        end = " ".join(map(str, self.eos))
        for keys in keyed:
            ids = " ".join(map(self.ids.__getitem__, keys))
            ids = f"{ids} {end}" if ids and end else ids or end
            text = " ".join([self.odd.get(k, k) for k in keys] if self.odd else keys)
            yield (ids.count(" ") + 1 if ids else 0), ids, text


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encodes every whole text with an end id and decodes the ids again.

    Returns one row per input row: the id column, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids (array of int)
    and decoded. A null text counts as empty and gives the end id alone. Repeated rows each give a row; a null id stays
    null. Texts of any length are encoded whole. Other columns of the input, whatever their names, are not read. An empty table
    gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if keep:
        schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model_path)
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            rows: list[list] = [[] for _ in range(5 if keep else 3)]
            for n, ids, text in codec.encode_batch([x or "" for x in batch.column(1).to_pylist()]):
                row = [n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                for column, x in zip(rows, row + ([np.fromstring(ids, np.int32, sep=" "), text] if keep else []), strict=True):
                    column.append(x)
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, types, strict=False))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: id, token ids and digests of every document that is left; the last stage, so other columns are not carried on.

    Null, empty and very long texts, repeated rows, null ids and empty tables are as encode_documents says."""
    small_batches(spark)
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True).drop("decoded")
