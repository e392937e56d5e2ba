"""JSON inside pages and replies, settings, encodings, hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from .extraction import role

SHARE = "data struct<biz_code:int, biz_msg:string, biz_data:struct<title:string, messages:array<struct<role:string, fragments:array<struct<type:string, content:string>>>>>>"
SCRIPTS = r"(?is)<script[^>]*(?:application/json|ld\+json)[^>]*>(.*?)</script>"
#: Texts whose readings a task holds at once.
PART = 64
#: Document settings with their default and, for numbers, their range.
SETTINGS = {"font_size": (12, 8, 32), "line_spacing": (360, 240, 720), "toc_levels": (3, 1, 3)}
CHOICES = {"paper": ("a4", ("a4", "letter")), "orientation": ("portrait", ("portrait", "landscape"))}


def share_messages(replies: DataFrame) -> DataFrame:
    """Messages of share replies: conv_id, ord, role, content, or one row with an error. replies: conv_id, body.

    Thinking fragments are left out, as are roles other than user and assistant and messages without text. Errors: not_json, refused
    (a business code other than 0), empty.
    """
    rows = replies.select("conv_id", F.from_json("body", SHARE, {"mode": "PERMISSIVE"}).alias("j")).select("conv_id", "j.data.*")
    good = lambda m: F.array_join(F.transform(F.filter(m.fragments, lambda f: ~F.upper(f.type).contains("THINK") & (trim(f.content) != "")), lambda f: f.content), "\n\n")
    messages = F.filter(F.transform("biz_data.messages", lambda m: F.struct(role(m.role).alias("role"), trim(good(m)).alias("content"))), lambda m: m.role.isin("user", "assistant") & (m.content != ""))
    rows = rows.select("conv_id", F.when(F.col("biz_code").isNull(), "not_json").when(F.col("biz_code") != 0, "refused").when(F.coalesce(F.size(messages), F.lit(0)) <= 0, "empty").alias("error"), messages.alias("m"))
    found = rows.where("error IS NULL").select("conv_id", F.posexplode("m").alias("ord", "x")).select("conv_id", "ord", "x.role", "x.content", F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return found.unionByName(rows.where("error IS NOT NULL").select("conv_id", F.lit(0).alias("ord"), none.alias("role"), none.alias("content"), "error"))


def embedded_json(pages: DataFrame) -> DataFrame:
    """JSON scripts of pages that parse: page_id, n (place among the page's scripts), kind (@type or null)."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPTS), F.lit(1))).alias("n", "s"))
    return rows.withColumn("v", F.try_parse_json("s")).where("v IS NOT NULL").select("page_id", "n", F.try_variant_get("v", "$['@type']", "string").alias("kind"))


def settings(rows: DataFrame) -> DataFrame:
    """Settings from JSON text of any shape: unknown choices and missing values give defaults, numbers are clamped."""
    parsed = F.from_json("json", ", ".join([f"{k} string" for k in (*SETTINGS, *CHOICES)]), {"mode": "PERMISSIVE"})

    def number(k: str, default: int, low: int, high: int) -> Column:
        x = F.expr(f"try_cast(j.{k} AS int)")
        return F.when(x.isNull(), default).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high))).alias(k)

    choice = lambda k, d, of: F.when(F.col(f"j.{k}").isin(*of), F.col(f"j.{k}")).otherwise(d).alias(k)
    return rows.withColumn("j", parsed).select("id", *(number(k, *v) for k, v in SETTINGS.items()), *(choice(k, *v) for k, v in CHOICES.items()))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of an ASCII string, as 8 hexadecimal digits."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619) % 4294967296)
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def navigation_junk(texts: DataFrame) -> DataFrame:
    """Texts under 1200 characters with 4 lines or more of which over 60 % are links: id."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), trim), lambda x: x != "")
    linkish = F.size(F.filter(lines, lambda x: x.rlike(r"^\[.*\]\(https?://") | x.rlike(r"^[-#>*]*[ \t]*\[.*\]\(")))
    return texts.where(F.length("text") < 1200).where((F.size(lines) >= 4) & (linkish / F.size(lines) > 0.6)).select("id")


def decodings(text: str) -> list[tuple[str, str]]:
    """Other readings (name, text) of a text whose characters are misread bytes, different from it and from each other."""
    data, found = bytes(ord(c) & 0xFF for c in text), {}
    for name, codec in (("utf8", "utf-8"), ("gbk", "gb18030"), ("big5", "big5")):
        found.setdefault(data.decode(codec, "replace"), name)
    again = data.decode("utf-8", "replace")
    found.setdefault(bytes(ord(c) & 0xFF for c in again).decode("utf-8", "replace"), "double-utf8")
    found.pop(text, None)
    return [(n, t) for t, n in found.items()]


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, place, name, reading) of (doc_id, text), PART texts at a time, so that a task holds the readings of a few only."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            rows = [(i, p, *r) for i, text in enumerate(part.column(1).to_pylist()) for p, r in enumerate(decodings(text))]
            own = part.take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=["doc_id", "text", "place", "name", "reading"])


def encoding_candidates(docs: DataFrame, suspicious: Column) -> DataFrame:
    """Readings of the texts that ``suspicious`` picks, ranked: recommended first, then fewest replacement characters, then the best
    share of sound characters, then the order of the readings: doc_id, name, replaced, quality, recommended, rank."""
    return readings(docs, suspicious).drop("reading")


def readings(docs: DataFrame, suspicious: Column) -> DataFrame:
    """The same with the text that each reading gives: reading."""
    from pyspark.sql import Window

    from .documents import REPLACED, SOUND

    q = lambda c: F.round(F.regexp_count(c, F.lit(SOUND)) / F.length(c), 6)
    rows = docs.where(suspicious & (F.length("text") > 0)).select("doc_id", "text")
    rows = rows.mapInArrow(decoded, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, place int, name string, reading string")
    rows = rows.select("doc_id", "place", "name", "reading", F.regexp_count("reading", F.lit(REPLACED)).alias("replaced"), q("reading").alias("quality"), F.regexp_count("text", F.lit(REPLACED)).alias("own"), q("text").alias("own_quality"))
    rows = rows.withColumn("recommended", (F.col("replaced") < F.col("own")) | ((F.col("replaced") == F.col("own")) & (F.col("quality") > F.col("own_quality") + 0.1)))
    w = Window.partitionBy("doc_id").orderBy(F.desc("recommended"), "replaced", F.desc("quality"), "place")
    return rows.withColumn("rank", F.row_number().over(w)).drop("own", "own_quality", "place")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a string as bytes, from two digests; the padded keys are constants of the plan."""
    key = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = lambda x: F.unhex(F.sha2(x, 256))
    return digest(F.concat(outer, digest(F.concat(inner, F.encode(message, "UTF-8")))))


def tickets(payload: Column, key: bytes) -> Column:
    """base64(payload).base64(HMAC of the payload)."""
    return F.concat(F.base64(F.encode(payload, "UTF-8")), F.lit("."), F.base64(hmac_sha256(payload, key)))
