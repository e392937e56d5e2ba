"""Operator 12 (native): secrets, told apart by who has them.

Candidates are spans of each text that look like credentials. Over the whole corpus every candidate's hash is counted by distinct
repositories and owners: what many owners have is an example that was copied widely, what one or two have is taken as live. Spans of the
base patterns are always reported; the method adds the other candidates that it takes as live. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import fresh, stored, table

#: The base patterns of the contract, in its order, with the group that holds the secret and its least length.
BASE: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
#: What a text must hold to be searched for a base pattern: the same spans, found faster.
QUICK = {"assign": BASE["assign"][0], "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Other candidates, tried in this order at each place behind the base patterns. The last is any long token of mixed characters.
ADDED: dict[str, str] = {
    "pem": "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*",
    "jwt": r"eyJ[A-Za-z0-9_-]{17,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "provider": r"(?:gh[opsu]_|github_pat_|xox[abps]-|sk-|AIza|glpat-)[A-Za-z0-9_-]{20,}",
    "login": r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[^\x00-\x20:/@]{6,64}@",
    "opaque": "[A-Za-z0-9+/_=-]{20,}",
}
ADDED_QUICK = "[A-Za-z0-9+/_=-]{20}|://|-----BEGIN "
KINDS = (*BASE, *ADDED)
#: An opaque token has so many upper-case letters, lower-case letters and digits, and so many different characters.
EACH_CLASS, DISTINCT = 2, 12
#: A candidate that more owners have is an example.
OWNERS = 2
#: Sums run over so many elements at a time.
CHUNK = 256


def running(sizes: Column) -> Column:
    """For each element of an array the sum of those before it, by chunks, so that a long array isn't copied for each element."""

    def fold(part: Column, start: Column) -> Column:
        first = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct((acc.at + x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)

    def chunked(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda i: F.slice(a, i * CHUNK + 1, CHUNK))
        return let(parts, lambda p: F.flatten(F.zip_with(p, fold(F.transform(p, total), F.lit(0)), fold)))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(sizes, lambda a: F.when(F.size(a) > 0, chunked(a)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a text as an array of (start, found), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = lambda f, p: F.zip_with(f, F.slice(p, 1, F.size(f)), lambda x, y: (F.length(x) + F.length(y)).cast("long"))
    # a match starts where the matches and pieces before it end, behind its own piece
    at = lambda f, p: F.zip_with(running(steps(f, p)), F.slice(p, 1, F.size(f)), lambda x, y: x + F.length(y))
    return let(found, lambda f: let(pieces, lambda p: F.arrays_zip(at(f, p).alias("start"), f.alias("found"))))


def spans_of(text: Column, kind: str) -> Column:
    """The spans of a base kind: array of (start, rank, end, hash)."""
    pattern, group, least = BASE[kind]
    secret = (lambda x: F.regexp_extract(x, pattern, group)) if group else (lambda x: x)
    longer = F.filter(matches(text, pattern), lambda m: F.length(secret(m.found)) >= least)
    return F.transform(longer, lambda m: span(m.start, m.found, F.lit(KINDS.index(kind)), secret(m.found)))


def span(start: Column, found: Column, rank: Column, secret: Column) -> Column:
    return F.struct(start.alias("start"), rank.alias("rank"), (start + F.length(found)).alias("end"), F.sha2(secret, 256).alias("hash"))


def mixed(x: Column) -> Column:
    classes = [F.regexp_count(x, F.lit(c)) >= EACH_CLASS for c in ("[A-Z]", "[a-z]", "[0-9]")]
    return reduce(lambda a, b: a & b, classes) & (F.size(F.array_distinct(F.split(x, ""))) >= DISTINCT)


def added_of(text: Column) -> Column:
    """The other candidates, as spans_of(). One search over all patterns, the base ones first, so none starts inside a base match."""
    base = [f"(?:{BASE['assign'][0]})".replace("(?:(?i)", "(?i:", 1), "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"]
    rank = lambda x: reduce(lambda rest, k: F.when(x.rlike(f"^(?:{ADDED[k]})\\z"), KINDS.index(k)).otherwise(rest), [k for k in reversed(ADDED)][1:], F.lit(KINDS.index("opaque")))
    is_base = lambda x: reduce(lambda a, b: a | b, (x.rlike(f"^(?:{p})\\z") for p in base))
    found = F.filter(matches(text, "|".join((*base, *ADDED.values()))), lambda m: ~is_base(m.found))
    ranked = F.transform(found, lambda m: span(m.start, m.found, rank(m.found), m.found).withField("fits", mixed(m.found)))
    return F.transform(F.filter(ranked, lambda s: (s.rank < KINDS.index("opaque")) | s.fits), lambda s: s.dropFields("fits"))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Rows (id, owner, repo, spans): every row's candidates by start, then kind; texts are searched only for what they may hold."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,hash:string>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.col(text_col).alias("text"))
    parts = [F.when(text.rlike(QUICK[k]), spans_of(text, k)).otherwise(none) for k in BASE]
    parts.append(F.when(text.rlike(ADDED_QUICK), added_of(text)).otherwise(none))
    return read.select("id", "owner", "repo", F.array_sort(F.concat(*parts)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """One row per candidate hash: n_spans, n_repos, n_owners. A repository is an owner's; counts are added up before each exchange."""
    each = found.select("owner", "repo", F.explode("spans.hash").alias("hash"))
    repos = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", owners: int = OWNERS) -> DataFrame:
    """One row per document: the id and ``spans``, an array of (start, end, kind, base, hash, n_spans, n_repos, n_owners, live), by start,
    then kind in the order of KINDS; places count code points, the end is exclusive.

    Base spans are all there. Other candidates are there if live: no more than ``owners`` owners have the candidate's text. No added span
    starts inside a base one; it may go on over one. Null and empty texts have no spans. A null owner or repository is one of its own. A text is
    searched whole, in time that grows with its length. Repeated rows are rows like any other and add to n_spans only; other columns
    are left out, whatever their names; an empty table gives none.
    """
    found = stored(candidates(docs, id_col, text_col, owner_col, repo_col), "secret-candidates")
    # rows with the same hashes, as copies of a text, share one list; so the join back has one row for each list
    listed = found.where(F.size("spans") > 0).select("*", F.sha2(F.array_join("spans.hash", ","), 256).alias("list"))
    lists = listed.groupBy("list").agg(F.first("spans.hash").alias("hashes")).select("list", F.explode(F.array_distinct("hashes")).alias("hash"))
    told = lists.join(ownership(found), "hash").groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct("hash", F.struct("n_spans", "n_repos", "n_owners")))).alias("told"))
    kinds = F.array(*map(F.lit, KINDS))

    def judged(s: Column) -> Column:
        counts, base = F.col("told")[s.hash], s["rank"] < len(BASE)
        return F.struct(
            s.start.alias("start"), s.end.alias("end"), F.get(kinds, s["rank"]).alias("kind"), base.alias("base"), s.hash.alias("hash"),
            counts.n_spans.alias("n_spans"), counts.n_repos.alias("n_repos"), counts.n_owners.alias("n_owners"), (counts.n_owners <= owners).alias("live"),
        )

    with_spans = listed.join(told, "list").select("id", F.filter(F.transform("spans", judged), lambda s: s.base | s.live).alias("spans"))
    without = found.where(F.size("spans") == 0).select("id", F.array().cast(with_spans.schema["spans"].dataType).alias("spans"))
    out = with_spans.unionByName(without)
    return out.select(F.col("id").alias(id_col), F.col("spans").alias(fresh(docs.select(id_col), "spans")[0]))


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Owners are the documents' sources, a repository is a source's documents of one language."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    n_of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(n_of, BASE),
        F.sha2(listed(F.filter("spans", lambda s: s.base)), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s.live)).cast("long").alias("n_live"),
    )
