"""Secrets in whole texts: exact patterns, and candidates judged by who else holds them.

Base spans come from three patterns.  Candidates are the values in base spans and
what wider generators propose beside them.  The hash of every candidate's value is
counted over the whole corpus by distinct repositories and distinct owners: a value
that many owners hold, or one owner in many repositories, is an example copied from
documentation; one that few hold and that has the look of a live key becomes a span
of kind "live".  Only JVM expressions are used.  Matches of one pattern don't
overlap each other, so what a candidate overlaps is found by halving.

Counts are pre-aggregated by (value, owner, repository) before each shuffle.  A
widely copied value has many rows in the join that follows; it reads two written
tables, so those rows can be split among tasks.

Nulls and ties: a null text has no spans and the digest of an empty list.  A null
owner or repository is one of its own.  Repeated rows are one repository and get
equal results.  Equal starts are ordered by kind as listed, then end.  Columns
besides doc_id, text, owner and repository are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellumix.llm.scratch import Scratch
from vellumix.llm.spans import all_matches, indexed, joined, labelled, let, meets

KINDS = ("assign", "access", "hex")
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
_NAME_PART = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_BEGIN, _END = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----", r"-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
#: Private keys up to their last line, or as far as they go; public prefixes of issued keys, signed tokens, credentials in addresses, and long mixed strings.
GENERATORS = (
    _BEGIN + r"(?:[^-]*+(?:-(?!----)[^-]*+){0,200}+" + _END + r"|(?:(?:\\[nr]|[\x20\x09-\x0D])*+[A-Za-z0-9+/=]{16,}+){0,400}+)",
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|ya29\.|npm_|pypi-|SG\.)[A-Za-z0-9_.-]{16,}",
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9_.-]{1,64}:[^\x20\x09-\x0D@/]{6,64}@",
    r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])",
)
#: What a text must hold for a pattern to match at all.
_GUARD = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}"}
_WIDE_GUARD = ("-----BEGIN", r"[A-Za-z0-9_.-]{18}", r"eyJ", r"://", r"[A-Za-z0-9+/_-]{32}")
_ADDRESS = r"^[a-z][a-z0-9+.-]*://[^:/]*:(.*)@$"
#: A private key of a shorter body is only a header: it has no value to compare, so each document's is its own.
LEAST_BODY = 16
#: Values that as many owners hold count as copied examples.
MANY_OWNERS = 3
#: So do values that one owner holds in more repositories than this.
MANY_REPOSITORIES = 10


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["text"], F.lit(rank).alias("rank")))


def _base(text: Column) -> Column:
    """For each kind, array<struct<start,end,text,rank>> of its pattern's checked matches."""

    def checked(found: Column) -> Column:
        assign, access, hex_ = (F.get(found, F.lit(i)) for i in range(len(KINDS)))
        assign = F.filter(assign, lambda s: F.length(F.regexp_replace(s["text"], _NAME_PART, "")) >= 6)
        access = F.filter(access, lambda s: F.length(s["text"]) >= 20)
        return F.array(*[_ranked(spans, i) for i, spans in enumerate((assign, access, hex_))])

    return let(all_matches(text, [(BASE[k], text.rlike(_GUARD[k])) for k in KINDS]), checked)


def _value(s: Column) -> Column:
    """A base span's value: an assignment without the name before it."""
    value = F.regexp_replace(s["text"], _NAME_PART, "")
    return F.struct((s["end"] - F.length(value)).alias("start"), s["end"].alias("end"), value.alias("text"), s["rank"].alias("rank"))


def _live_looking(value: Column) -> Column:
    """Many different characters, several kinds of them but in an address's password, no words that mark examples."""
    address = value.rlike(_ADDRESS)
    part = F.when(address, F.regexp_extract(value, _ADDRESS, 1)).otherwise(value)
    kinds = value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int") + value.rlike("[0-9]").cast("int")
    varied = F.size(F.array_distinct(F.split(part, ""))) * 2.5 >= F.least(F.length(part), F.when(part.rlike("^[0-9a-f]+$"), 24).otherwise(40))
    plain = ~part.rlike(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|1234567|abcdef|(.)\1{4}")
    hexadecimal = value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{64})$") & (kinds >= 2)
    return value.startswith("-----BEGIN") | ((address | hexadecimal | (kinds >= 3)) & varied & plain)


def _key(value: Column, holder: Column) -> Column:
    """The hash of a value: of a private key's body however its lines are broken; of a bare header, with its holder."""
    body = F.regexp_replace(F.regexp_replace(value, f"{_BEGIN}|{_END}", ""), r"\\[nr]|[^A-Za-z0-9+/=]", "")
    private = F.when(F.length(body) >= LEAST_BODY, body).otherwise(F.concat(value, holder))
    return F.sha2(F.when(value.startswith("-----BEGIN"), private).otherwise(F.regexp_replace(value, _NAME_PART, "")), 256)


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", many_owners: int = MANY_OWNERS, many_repositories: int = MANY_REPOSITORIES) -> DataFrame:
    """doc_id, base and all spans, and at how many places there are values that are widely copied.

    spans: array of struct(start, rank, end, kind), ends exclusive, in code points.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))

    def free(lists: Column, index: Column) -> Column:
        """Each list without spans that meet one of an earlier list, flattened."""
        return F.flatten(F.transform(lists, lambda spans, i: F.filter(spans, lambda s: ~meets(F.slice(index, F.lit(1), i), s))))

    def judge(base: Column) -> Column:
        found = all_matches(text, [(p, text.rlike(g)) for p, g in zip(GENERATORS, _WIDE_GUARD)])
        wide = F.transform(found, lambda spans, i: F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["text"], i.alias("rank"))))

        def clear(lists: Column) -> Column:
            beside = F.filter(let(indexed(lists), lambda index: free(lists, index)), lambda s: ~s["own"])
            # a value that two kinds read alike counts once
            values = F.transform(let(indexed(base), lambda index: free(base, index)), _value)
            return F.filter(F.concat(F.transform(beside, lambda s: F.struct(s["start"], s["end"], s["text"], s["rank"])), values), lambda s: _live_looking(s["text"]))

        marked = lambda lists, own: F.transform(lists, lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["text"], s["rank"], F.lit(own).alias("own"))))
        some = let(F.concat(marked(base, True), marked(wide, False)), lambda lists: F.when(F.size(F.flatten(lists)) > 0, clear(lists)))
        none = F.array().cast("array<struct<start:int,end:int,text:string,rank:int>>")
        return F.struct(F.flatten(base).alias("base"), F.coalesce(some, none).alias("wide"))

    named = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.xxhash64("text").alias("h"), let(_base(text), judge).alias("s"))
    holder = F.to_json(F.struct("owner", "repository", "doc_id"))
    keyed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["rank"], _key(s["text"], holder).alias("key")))
    found = scratch.put(named.select("doc_id", "owner", "repository", "h", keyed(F.col("s.base")).alias("base"), keyed(F.col("s.wide")).alias("wide")), "found")

    held = found.select("doc_id", "owner", "repository", "h", F.explode(F.concat("base", "wide")).alias("c")).select("doc_id", "owner", "repository", "h", F.col("c.key").alias("key"))
    held = scratch.put(held.distinct(), "held")
    spread = held.select("key", F.coalesce("owner", F.lit("")).alias("o"), F.col("owner").isNull().alias("n"), "repository").distinct()
    spread = spread.groupBy("key", "o", "n").agg(F.count("*").alias("repositories")).groupBy("key").agg(F.count("*").alias("owners"), F.max("repositories").alias("repositories"))
    spread = scratch.put(spread, "spread")
    judged = held.join(spread, "key").where((F.col("owners") >= many_owners) | (F.col("repositories") > many_repositories)).groupBy("doc_id", "h").agg(F.collect_set("key").alias("copied"))
    judged = scratch.put(judged, "judged")
    scratch.drop(held)
    right = judged.select(F.col("doc_id").alias("j_doc"), F.col("h").alias("j_h"), "copied")
    out = found.join(right, found["doc_id"].eqNullSafe(right["j_doc"]) & (found["h"] == right["j_h"]), "left")
    copied = F.coalesce(F.col("copied"), F.array().cast("array<string>"))
    of = lambda rank: F.filter("base", lambda s: s["rank"] == rank)
    base = F.array_sort(F.concat(*[labelled(of(i), kind, i) for i, kind in enumerate(KINDS)]))
    live = labelled(F.filter("wide", lambda s: ~F.array_contains(copied, s["key"])), "live", len(KINDS))
    places = F.array_distinct(F.transform(F.filter(F.concat("base", "wide"), lambda s: F.array_contains(copied, s["key"])), lambda s: s["end"]))
    n_copied = F.size(places).cast("long")
    return out.select("doc_id", base.alias("base"), F.array_sort(F.concat(base, live)).alias("spans"), n_copied.alias("n_copied"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_copied")
