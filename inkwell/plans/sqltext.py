"""Pieces of DuckDB SQL that stand for the column functions of this package in the queries' SQL."""

from __future__ import annotations

from ..functions.text import INVISIBLE, NARROW, NBSP, WIDE, WS
from ..operators.lines import MARKERS
from ..sources.messy import LINES_SQL


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def trim_start(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+', '')"


def trim_end(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def without_code(x: str) -> str:
    return f"CASE WHEN {count(x, '`')} % 2 = 0 THEN regexp_replace({x}, '`[^`]*`', '', 'g') ELSE {x} END"


def clean(x: str) -> str:
    return f"translate(replace(regexp_replace({x}, '[{INVISIBLE}]', '', 'g'), '{NBSP}', ' '), '{WIDE}', '{NARROW}')"


def fenced(marker: str = "ticks", source: str = "lines") -> str:
    """CTEs ending in ``f``: lines with marker and in_fence."""
    return f"""m0 AS (SELECT *, regexp_matches(line, '{MARKERS[marker]}') AS marker FROM {source}),
f AS (SELECT *, marker OR sum(marker::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) % 2 = 1 AS in_fence FROM m0)"""


BASE = LINES_SQL
