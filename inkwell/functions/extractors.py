"""Extractors as table functions: what a page holds by kind, and the turns of a conversation.

``register(spark)`` adds extract(text, kind) for lateral joins, whose columns follow from the kind, and dialogue(TABLE(...)), which asks for its rows
by conversation and in order. New kinds are added to EXTRACTORS.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType


class Extractor(NamedTuple):
    """The columns of a kind, and its rows in a text."""

    columns: StructType
    rows: Callable[[str], Iterator[tuple]]


LINK = re.compile(r"""<a\b[^>]*?\bhref="([^"]*)"[^>]*>([^<]*)</a>""", re.ASCII)
META = re.compile(r"""<meta\b[^>]*?\b(name|property|charset)="([^"]*)"(?:\s+content="([^"]*)")?""", re.ASCII)
TAG = re.compile(r"<([a-z][a-z0-9]*)", re.ASCII)


def links(text: str) -> Iterator[tuple]:
    for n, m in enumerate(LINK.finditer(text)):
        yield n, m[1], m[2]


def metadata(text: str) -> Iterator[tuple]:
    for m in META.finditer(text):
        yield m[1], m[2], m[3]


def tags(text: str) -> Iterator[tuple]:
    counts: dict[str, int] = {}
    for m in TAG.finditer(text):
        counts[m[1]] = counts.get(m[1], 0) + 1
    yield from sorted(counts.items())


def columns(**types: type) -> StructType:
    out = StructType()
    for name, kind in types.items():
        out.add(name, kind())
    return out


EXTRACTORS: dict[str, Extractor] = {
    "links": Extractor(columns(n=IntegerType, href=StringType, label=StringType), links),
    "metadata": Extractor(columns(attribute=StringType, key=StringType, content=StringType), metadata),
    "tags": Extractor(columns(tag=StringType, n=LongType), tags),
}


@udtf
class Extract:
    """extract(text, kind): the rows of a kind; none for a null text. The kind must be a constant."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(kind.value, str) or kind.value not in EXTRACTORS:
            raise ValueError(f"kind must be one of {', '.join(EXTRACTORS)}")
        return AnalyzeResult(EXTRACTORS[kind.value].columns)

    def eval(self, text: str, kind: str):
        if text is not None:
            yield from EXTRACTORS[kind].rows(text)


@udtf
class Dialogue:
    """dialogue(TABLE(turns)): neighbouring messages of one role as one: conv_id, first_turn, role, n_messages, n_chars. The rows need conv_id, turn,
    role and text; they come by conversation, in order of turn and role."""

    @staticmethod
    def analyze(turns: AnalyzeArgument) -> AnalyzeResult:
        if missing := {"conv_id", "turn", "role", "text"} - set(turns.dataType.names):
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        schema = StructType().add("conv_id", turns.dataType["conv_id"].dataType).add("first_turn", turns.dataType["turn"].dataType)
        schema = schema.add("role", StringType()).add("n_messages", LongType()).add("n_chars", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("conv_id")], orderBy=[OrderingColumn("turn"), OrderingColumn("role"), OrderingColumn("text")])

    def __init__(self):
        self.now: list[Any] | None = None

    def eval(self, row):
        if self.now and self.now[2] == row["role"]:
            self.now[3] += 1
            self.now[4] += len(row["text"] or "")
        else:
            if self.now:
                yield tuple(self.now)
            self.now = [row["conv_id"], row["turn"], row["role"], 1, len(row["text"] or "")]

    def terminate(self):
        if self.now:
            yield tuple(self.now)


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract", Extract)
    spark.udtf.register("dialogue", Dialogue)
