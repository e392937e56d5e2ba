"""Chat messages in the data that pages carry: JSON scripts, assigned state, and streams of fragments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from .extraction import role

# How deep and for how many messages JSON is walked, and how far a page's data is looked at.
DEPTH, MESSAGES = 24, 501
STATE_CHARS, WINDOW_CHARS, PARTS_CHARS = 3_000_000, 4_000, 200_000

# Where the data starts.
SCRIPT = re.compile(r"""<script[^>]*type="application/(?:ld\+)?json"[^>]*>([\s\S]*?)</script>|<script[^>]*id="js-initialData"[^>]*>([\s\S]*?)</script>""", re.I)
STATE = re.compile(r"window\.__INITIAL_STATE__\s*=[\s;]*")
FLIGHT_ROLE = re.compile(r'"(?:author"\s*:\s*\{\s*"role|role)"\s*:\s*"(user|assistant|human|ai)"')
PARTS = '"parts":['

#: A string, whose brackets don't count, or a bracket.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[{]|[\]}]', re.S)
MESSAGE = "array<struct<layer:string, path:string, raw:string, content:string>>"


def parsed(text: str) -> object:
    """The JSON value, or None where it doesn't parse."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def balanced(text: str, at: int, most: int) -> str | None:
    """The object or array that starts at a place, with its brackets balanced, or None."""
    if text[at : at + 1] not in ("{", "["):
        return None
    depth = 0
    for m in TOKEN.finditer(text, at, min(len(text), at + most)):
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[at : m.end()]
    return None


def strings(parts: list) -> str:
    return "\n\n".join(p for p in parts if isinstance(p, str))


def spoken(node: dict) -> tuple[str, str] | None:
    """(role as it is written, text) of a node that has both."""
    of = lambda key, field: node[key].get(field) if isinstance(node.get(key), dict) else None
    raw = next((x for x in (of("author", "role"), node.get("role")) if x is not None), None)
    parts = next((x for x in (of("content", "parts"), node.get("parts")) if x is not None), None)
    text = next((x for x in (of("content", "text"), node.get("text")) if x is not None), None)
    if isinstance(parts, list):
        text = strings(parts)
    elif not (isinstance(text, str) and text.strip()):
        text = node.get("content")
    return (raw, text) if isinstance(raw, str) and isinstance(text, str) else None


def walk(value: object, path: str = "", depth: int = DEPTH) -> Iterator[tuple[str, str, str]]:
    """(path, role, text) of all message nodes down to a depth, parents first and fields in the order they are written."""
    if depth < 0 or not isinstance(value, (dict, list)):
        return
    if isinstance(value, dict):
        found = spoken(value)
        if found:
            yield path, *found
    for i, child in enumerate(value.values() if isinstance(value, dict) else value):
        yield from walk(child, f"{path}.{i:06d}", depth - 1)


def sound(layer: str, rows: Iterator[tuple[str, str, str]]) -> list[dict]:
    """Rows as structs; halves of surrogate pairs, which JSON can hold, become question marks."""
    clean = lambda x: x.encode("utf-8", "replace").decode()
    return [{"layer": layer, "path": p, "raw": clean(r), "content": clean(t)} for p, r, t in rows]


def flight(html: str) -> Iterator[tuple[str, str, str]]:
    """A role and the nearest parts behind it, wherever fragments of a stream hold both."""
    at = 0
    while m := FLIGHT_ROLE.search(html, at):
        at = m.end()
        found = html.find(PARTS, m.start(), m.start() + WINDOW_CHARS)
        array = balanced(html, found + len(PARTS) - 1, PARTS_CHARS) if found >= 0 else None
        if array:
            at = found + len(PARTS) - 1 + len(array)
            parts = parsed(array)
            if isinstance(parts, list):
                yield f".{m.start():09d}", m[1], strings(parts)


def layered(html: str) -> list[dict]:
    """Messages of a page's JSON scripts and assigned states, followed by those of its stream."""
    texts = [m[1] or m[2] or "" for m in SCRIPT.finditer(html)]
    texts += [x for m in STATE.finditer(html) if (x := balanced(html, m.end(), STATE_CHARS))]
    return [s for i, x in enumerate(texts) for s in sound("json", walk(parsed(x), f".{i:06d}"))] + sound("flight", flight(html))


def said(messages: Column) -> Column:
    """Messages with a known role and some text, at most MESSAGES of them."""
    rows = F.transform(messages, lambda m: F.struct(m.layer.alias("layer"), m.path.alias("path"), role(m.raw).alias("role"), trim(m.content).alias("content")))
    return F.slice(F.filter(rows, lambda m: m.role.isNotNull() & (m.content != "")), 1, MESSAGES)


def json_messages(rows: DataFrame) -> DataFrame:
    """Messages found anywhere in JSON of any shape: id, path, role, content, in the order of path. rows: id, json.

    A node with a role (its own or its author's) is a message if it has text: its parts joined, its text, or its content. Null JSON and
    JSON that doesn't parse have none. Each row is walked on its own, down to DEPTH levels and MESSAGES messages.
    """

    @F.pandas_udf(MESSAGE)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: sound("json", walk(parsed(x))) if isinstance(x, str) else [])

    return rows.select("id", F.explode(said(found("json"))).alias("m")).select("id", "m.path", "m.role", "m.content")


def page_messages(pages: DataFrame) -> DataFrame:
    """Messages of pages by the first layer that has any: conv_id, turn from 0, role, text, layer (json or flight). pages: conv_id, html."""

    @F.pandas_udf(MESSAGE)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: layered(x) if isinstance(x, str) else [])

    rows = pages.select("conv_id", found("html").alias("m"))
    data, stream = said(F.filter("m", lambda m: m.layer == "json")), said(F.filter("m", lambda m: m.layer == "flight"))
    first = F.when(F.size(data) > 0, data).otherwise(stream)
    return rows.select("conv_id", F.posexplode(first).alias("turn", "m")).select("conv_id", "turn", "m.role", F.col("m.content").alias("text"), "m.layer")
