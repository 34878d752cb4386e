"""From raw documents to a training mix: five stages, each written as Parquet and read again.

Language identification rejects documents without a letter and those whose bytes
look like noise to a network that learned it beside the languages; line dedup cuts
each source's boilerplate lines; near-dedup keeps one document of each group of
five-word-shingle similarity 0.8 or more; decontamination drops documents that
give benchmark items away; mixing assigns what is left to training positions.
Every stage reads all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellumix.llm import decontam, langid, lines, mixing
from vellumix.llm.neardup import near_duplicates
from vellumix.llm.scratch import Scratch, bounded

#: Removed ids up to this many (8 bytes each) are broadcast; more are joined by shuffle.
_BROADCAST_IDS = 1_000_000
#: Texts that a task of the language stage holds at once; it writes its rows itself, as only then this holds.
_BATCH_ROWS = 512


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = langid.keep_known(docs, langid.fit_rejecting(docs))
    return Scratch(spark, "pipeline").put(known, "known", _BATCH_ROWS)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(docs, host="source")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group; of rows repeated in full, one; rows without id or words stay."""
    judged = Scratch(spark, "pipeline").put(near_duplicates(docs, width=5, num=80, den=100).select("doc_id", "kept"), "judged")
    removed = judged.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__vx_doc")).distinct()
    if bounded(removed, _BROADCAST_IDS):
        removed = F.broadcast(removed)
    left = docs.join(removed, docs["doc_id"] == removed["__vx_doc"], "left_anti")
    repeated = judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__vx_doc"))
    if repeated.isEmpty():
        return left
    if bounded(repeated, _BROADCAST_IDS):
        repeated = F.broadcast(repeated)
    same = left["doc_id"] == repeated["__vx_doc"]
    return left.join(repeated, same, "left_anti").union(left.join(repeated, same, "left_semi").dropDuplicates())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", cut_boilerplate),
    ("minhash_neardup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: The network and the sketches have no SQL counterpart; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        after = scratch.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
