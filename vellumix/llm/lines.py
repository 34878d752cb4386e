"""Line dedup by site-relative frequency, in JVM expressions only.

A host's boilerplate lines are those on more than `ratio` of its pages, and on
`least_pages` at least.  Lines are counted by host and 64-bit hash, once a page,
with partial counts before the shuffle.  A host has at most (lines per page /
ratio) such lines, so they travel as one array per host; the join that brings
them to the pages reads two plain tables, so Spark can split a hot host's rows or
broadcast a small table by its size.

Nulls and ties: a null text has no lines and stays null; null hosts are one host.
Blank lines are layout and always stay.  A boilerplate line goes each time a page
repeats it.  A page of nothing else becomes an empty text; no row is dropped.
Repeated rows each count as a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vellumix.llm.scratch import Scratch
from vellumix.llm.spans import let

RATIO, LEAST_PAGES = 0.1, 10
_HOST, _KEYS = "__vx_host", "__vx_keys"


def boilerplate(docs: DataFrame, host: str, ratio: float, least_pages: int, scratch: Scratch) -> DataFrame:
    """Host and the hashes of its boilerplate lines."""
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\s]"))
    keys = F.array_distinct(F.transform(lines, lambda s: F.xxhash64(s)))
    pages = docs.groupBy(F.col(host).alias(_HOST)).agg(F.count("*").alias("pages"))
    seen = docs.select(F.col(host).alias(_HOST), F.explode(keys).alias("key")).groupBy(_HOST, "key").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    seen, pages = scratch.put(seen, "seen"), scratch.put(pages.withColumnRenamed(_HOST, "h"), "pages")
    often = seen.join(pages, seen[_HOST].eqNullSafe(pages["h"])).where(F.col("n") > F.col("pages") * ratio)
    sets = scratch.put(often.groupBy(_HOST).agg(F.collect_list("key").alias(_KEYS)), "sets")
    scratch.drop(seen, pages)
    return sets


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counted: bool = False) -> DataFrame:
    """docs with boilerplate lines cut from text; with counted, also n_lines and n_dropped."""
    sets = boilerplate(docs, host, ratio, least_pages, Scratch(docs.sparkSession, "lines"))
    joined = docs.join(sets, docs[host].eqNullSafe(sets[_HOST]), "left")
    empty = F.struct(F.col("text").alias("text"), F.lit(0).alias("dropped"))

    def cut(lines):
        own = F.array_intersect(F.transform(lines, lambda s: F.xxhash64(s)), F.col(_KEYS))

        def with_hits(hits):
            kept = F.filter(lines, lambda s: ~F.array_contains(hits, F.xxhash64(s)) | ~s.rlike(r"[^\s]"))
            shorter = let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), (F.size(lines) - F.size(k)).alias("dropped")))
            return F.when(F.size(hits) > 0, shorter).otherwise(empty)

        return let(own, with_hits)

    result = F.when(F.col(_KEYS).isNull() | F.col("text").isNull(), empty).otherwise(let(F.split("text", "\n", -1), cut))
    joined = joined.withColumn("__vx_cut", result)
    columns = [F.col("__vx_cut.text").alias("text") if c == "text" else docs[c] for c in docs.columns]
    if counted:
        n = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
        columns += [F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.col("__vx_cut.dropped").cast("long").alias("n_dropped")]
    return joined.select(*columns)
