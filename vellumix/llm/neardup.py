"""Near-duplicate documents: SetSketch bands for candidates, exact sets for links.

Every text becomes the set of hashes of its word shingles.  Equal sets form one
class, so thousands of copies weigh as much as one.  Bands of register values put
likely pairs of classes into buckets; each bucket's members are compared with one
member of it (another in every band), first by the joint likelihood of the two
sketches, then on the full sets.  Buckets of three or more whose members are not all
connected by then are compared block against block on full sets, without writing
out pairs.  Blocks are bounded by members and by shingles, and hold sorted hashes
instead of texts.  What remains is the chance that a pair shares no band,
(1 - s**rows) ** bands, 1e-8 for s = 0.85 and 6e-7 for s = 0.80, and that the
estimate of a true pair falls short by SLACK, under 1e-10 by the binomial tail.

Nulls and ties: a null or wordless text has an empty set and is linked with
nothing.  A row without doc_id takes part like any other; its own component_id is
null if no linked document has an id.  Repeated rows share a class and get equal
results.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellumix.llm import setsketch
from vellumix.llm.components import components, near_labels
from vellumix.llm.scratch import Scratch, bounded
from vellumix.llm.tokens import released, shingle_sets
from vellumix.session import ship

BANDS, ROWS = 20, 3
#: Members, and shingles on average, of a block; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Rows of whole texts or sets that a task holds at once.
BATCH_ROWS = 256
#: A sketch of 60 registers errs by less than 0.05 in one of three cases; eight times that is kept for the exact test.
SLACK = 0.4
_CELLS = 1 << 22
#: Up to this many classes whose texts are wanted (a digest and a key, 40 bytes each) are broadcast to the scan; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def digest_of(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(width: int):
    registers = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            held: list[np.ndarray] = []
            weight = 0

            def flush():
                if held:
                    starts = np.cumsum([0] + [len(x) for x in held[:-1]])
                    filled = iter(setsketch.registers(np.concatenate(held), starts, registers).astype(">u2"))
                    for i in range(len(sketches), len(sizes)):
                        sketches.append(next(filled).tobytes() if sizes[i] else None)
                    held.clear()

            for _, shingles in shingle_sets(batch.column("text"), width):
                sizes.append(len(shingles))
                digests.append(digest_of(shingles) if len(shingles) else None)
                if len(shingles):
                    held.append(shingles)
                    weight += len(shingles)
                if weight > 200_000:
                    flush()
                    weight = 0
            flush()
            sketches += [None] * (len(sizes) - len(sketches))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "place", "n_shingles", "digest", "sketch"])

    return released(run)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, place (where to find the text), n_shingles, digest of the set, registers as big-endian bytes."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed(docs).mapInArrow(_signatures(width), f"doc_id {kind}, place long, n_shingles long, digest binary, sketch binary")


def placed(docs: DataFrame) -> DataFrame:
    """A join key for each row that doesn't gather the rows without doc_id."""
    own = F.col("doc_id").cast("long") if docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte") else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return docs.select("doc_id", F.coalesce(own, F.xxhash64("text")).alias("place"), "text")


def _likely(num: int, den: int):
    floor = num / den - SLACK

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            nx, ny = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            keep = setsketch.joint_similarity(x, y, nx, ny) >= floor
            keep &= den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _true_sets(width: int):
    """(digest, sorted hashes as bytes) of rows whose set has the wanted digest: rows may share a doc_id."""

    def run(batches):
        for batch in batches:
            wanted = batch.column("digest").to_pylist()
            held: tuple[list, list] = ([], [])
            for i, shingles in shingle_sets(batch.column("text"), width):
                if digest_of(shingles) == wanted[i]:
                    held[0].append(wanted[i])
                    held[1].append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in held], ["digest", "shingles"])

    return released(run)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column("set_a")), _sets(batch.column("set_b"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets, in memory of a fixed bound."""
    n = len(sets)
    both = np.zeros((n, n), np.float64)
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    keep = shared[place]
    owner, at = owner[keep], column[place[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    step = max(1, _CELLS // n)
    for lo in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(at, (lo, lo + step))
        cells = np.zeros((n, step), np.float32)
        cells[owner[i:j], at[i:j] - lo] = 1
        both += cells @ cells.T
    return both.astype(np.int64)


def _blocks(num: int, den: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        digests, labels = table.column("digest").to_pylist(), table.column("label").to_pylist()
        if len(set(labels)) < 2:
            return schema.empty_table()
        sets = _sets(table.column("shingles"))
        sizes = np.array([len(s) for s in sets])
        number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        label = np.array([number[x] for x in labels])
        both = overlaps(sets)
        linked = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
        linked &= label[:, None] != label[None, :]
        parent = list(range(len(number)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1))):
            x, y = root(label[i]), root(label[j])
            if x != y:
                parent[x] = y
                found.append((digests[i], digests[j]))
        return pa.table([[x for x, _ in found], [y for _, y in found]], schema=schema)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs.

    Two documents are linked if den * |intersection| >= num * |union| of their
    sets of `width`-word shingles; component_id is the least doc_id reachable.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    signed = scratch.put(signatures(docs, width), "signed", BATCH_ROWS)
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("place").alias("place"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.put(classes, "classes")
    buckets, members = _buckets(classes, scratch)
    pairs = _likely_pairs(classes, members, num, den, scratch)
    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).union(members.where("n > 2").select("digest")).distinct()
    wanted = scratch.put(wanted.join(classes.select("digest", "place"), "digest"), "wanted")
    few = F.broadcast(wanted) if bounded(wanted, BROADCAST_ROWS) else wanted
    sets = placed(docs).join(few, "place").select("digest", "text").mapInArrow(_true_sets(width), "digest binary, shingles binary")
    sets = scratch.put(sets, "sets", BATCH_ROWS)
    edges = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("set_b")), "b")
    edges = scratch.put(edges.mapInArrow(_confirm(num, den), "a binary, b binary"), "confirmed", BATCH_ROWS)
    labels = near_labels(edges, scratch)
    rest = _unsettled(labels, members, sets, num, den, scratch)
    found = _joined_up(edges.union(rest), labels, scratch)
    roots = classes.select("digest", "first_id").join(found.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "first_id", F.coalesce("root", "digest").alias("root"))
    roots = scratch.put(roots, "roots")
    least = scratch.put(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = scratch.put(roots.join(least, "root").select("digest", "component_id"), "named")
    scratch.drop(classes, buckets, members, pairs, wanted, sets, edges, rest, roots, least)
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _buckets(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Bands shared by two classes or more, with one class of each as its center, and their members."""
    wide = 2 * ROWS
    keys = F.array(*[F.expr(f"substring(sketch, {1 + wide * i}, {wide})") for i in range(BANDS)])
    bands = classes.select("digest", F.col("n").alias("size"), F.posexplode(keys).alias("band", "key"))
    first = F.min(F.struct(F.xxhash64("band", "digest").alias("h"), "digest"))
    buckets = bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), first.alias("c")).where("n > 1").select("band", "key", "n", "weight", F.col("c.digest").alias("center"))
    buckets = scratch.put(buckets, "buckets")
    return buckets, scratch.put(bands.join(buckets, ["band", "key"]), "members")


def _likely_pairs(classes: DataFrame, members: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    pairs = members.where("digest <> center").select(F.least("digest", "center").alias("a"), F.greatest("digest", "center").alias("b")).distinct()
    pairs = scratch.put(pairs, "stars")

    def side(name: str) -> DataFrame:
        return classes.select(F.col("digest").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(num, den), "a binary, b binary")
    likely = scratch.put(likely, "pairs")
    scratch.drop(pairs)
    return likely


def _joined_up(edges: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) from all links, solved between the labels instead of the nodes."""
    short = edges
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        short = short.join(own, end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    found = scratch.put(components(short.select("a", "b"), scratch), "found")
    over = labels.join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    over = over.select("node", F.coalesce("top", "root").alias("root"))
    return over.union(found.join(labels.select("node"), "node", "left_anti"))


def _unsettled(found: DataFrame, members: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links between components that share a bucket, by comparing its blocks of members on full sets."""
    labels = members.where("n > 2").select("band", "key", "n", "weight", "digest").join(found.withColumnRenamed("node", "digest"), "digest", "left")
    labels = scratch.put(labels.withColumn("label", F.coalesce("root", "digest")).drop("root"), "labels")
    split = labels.groupBy("band", "key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("band", "key")
    split = scratch.put(split, "split")
    open_ = labels.join(split, ["band", "key"]).withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int"))
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    open_ = open_.select("band", "key", "label", "digest", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    open_ = scratch.put(open_, "open")
    tasks = open_.join(sets, "digest").select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "label", "digest", "shingles")
    links = tasks.groupBy("band", "key", "i", "j").applyInArrow(_blocks(num, den), "a binary, b binary")
    links = scratch.put(links.distinct(), "links", BATCH_ROWS)
    scratch.drop(labels, split, open_)
    return links
