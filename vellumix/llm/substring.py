"""Substring dedup: repeated windows of words, cut down to their first occurrence.

Every window of `width` consecutive words gets two Rabin-Karp hashes: bits of the
one choose its bucket, the other tells windows of a bucket apart.  A map task keeps,
of each hash, only its first window (the others are known repeats there and then)
and packs those by bucket, so that a hash reaches its bucket at most once a chunk
however often it occurs.  A bucket's task counts its windows and marks all but the
first of each hash; the marks travel to the documents and merge into maximal
intervals, which are cut from the whole text.

A chunk is dealt to FAN buckets at most, so its packets stay worth sending; where a
corpus needs more buckets, further passes deal each bucket's windows again.  So the
work for a gigabyte grows only with the number of passes: one up to 60 GB, two up
to 240 TB.  Windows are told apart by 64 bits and the bucket's: the expected number
of unequal windows taken for equal is n * n / 2**(65 + bits) for n windows, 4e-6 for
0.5 GB and about 1 for 100 TB.

Nulls and ties: a null or short text has no window.  Rows without doc_id count as
one document before all others.  Of rows that share a doc_id, no window is
earlier than one with an equal start; their texts keep their own marks.  Ids that
are no whole numbers are ordered as Spark orders them.  Repeated rows get equal
results.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vellumix.llm.scratch import Scratch
from vellumix.llm.tokens import doc_groups, hash_words, inside, other_rolling, rolling, text_buffers, word_spans
from vellumix.session import ship

_U = np.uint64
CHUNK_WINDOWS = 2_000_000
#: Windows that a bucket's task, and text bytes that a documents' task, should hold.
BUCKET_WINDOWS, GROUP_TEXT = 3_000_000, 16 << 20
#: Buckets that one pass deals a chunk to; a power of two.
FAN = 4096
_PLANES = 8
_NAMELESS = -(1 << 63)
_MARKS = pa.schema([("group", pa.int32()), ("marks", pa.binary())])
_PACKED = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])


def pack(docs: np.ndarray, variants: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None, tags: np.ndarray | None = None) -> bytes:
    """Entries in runs of one document, sorted by start: documents and gaps compressed, hashes and tags as planes of bytes."""
    n = len(docs)
    new = np.ones(n, bool)
    new[1:] = (docs[1:] != docs[:-1]) | (variants[1:] != variants[:-1])
    first = np.flatnonzero(new)
    gaps = np.empty(n, np.uint32)
    gaps[0], gaps[1:] = 0, np.diff(starts.astype(np.int64)).astype(np.uint32)
    gaps[first] = starts[first]
    ids = docs[first]
    steps = np.diff(ids, prepend=ids[:1] * 0)
    head = np.array([n, len(first)], np.int64).tobytes()
    parts = [steps.astype(np.int64), variants[first].astype(np.int32), np.diff(np.append(first, n)).astype(np.uint32), gaps]
    body = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in parts)
    body = zlib.compress(head + body, 1)
    out = np.array([len(body)], np.int64).tobytes() + body
    for x in (hashes, tags):
        if x is not None:
            out += x.view(np.uint8).reshape(n, 8).T.tobytes()
    return out


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, variants, starts, hashes and tags; zeros for what was not packed."""
    size = int(np.frombuffer(packed, np.int64, 1)[0])
    body = zlib.decompress(packed[8 : 8 + size])
    n, m = (int(x) for x in np.frombuffer(body, np.int64, 2))
    at, parts = 16, []
    for count, kind in ((m, np.int64), (m, np.int32), (m, np.uint32), (n, np.uint32)):
        wide = np.dtype(kind).itemsize
        parts.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, count * wide, at).reshape(wide, count).T).view(kind).ravel())
        at += count * wide
    steps, variants, counts, gaps = parts
    first = np.cumsum(counts) - counts
    sums = np.cumsum(gaps.astype(np.int64))
    starts = sums - np.repeat(sums[first] - gaps[first], counts)
    planes = np.frombuffer(packed, np.uint8, offset=8 + size).reshape(-1, _PLANES, n) if n else np.zeros((0, _PLANES, 0), np.uint8)
    hashes, tags = (np.ascontiguousarray(planes[i].T).view(_U).ravel() if i < len(planes) else np.zeros(n, _U) for i in (0, 1))
    return np.repeat(np.cumsum(steps), counts), np.repeat(variants, counts), starts, hashes, tags


def _sorted_runs(key: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and tag, and which places of it start a new one."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    if (tags[order[1:]] != tags[order[:-1]])[~new[1:]].any():  # equal keys with unequal tags, hardly ever
        order = np.lexsort((tags, key))
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (tags[order[1:]] != tags[order[:-1]])
    return order, new


def later(hashes: np.ndarray, tags: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: a window whose hash and tag also start earlier; one that represents them.

    Windows of equal document and start (rows that share a doc_id) are equally early.
    """
    order, new = _sorted_runs(hashes, tags)
    repeat = np.zeros(len(hashes), bool)
    chosen = np.zeros(len(hashes), bool)
    chosen[order[new]] = True
    run = np.cumsum(new) - 1
    sizes = np.bincount(run)
    many = sizes[run] > 1
    if many.any():
        sub, own = order[many], run[many]
        by = np.lexsort((starts[sub], docs[sub], own))
        sub, own = sub[by], own[by]
        head = np.ones(len(sub), bool)
        head[1:] = own[1:] != own[:-1]
        lead = sub[np.maximum.accumulate(np.where(head, np.arange(len(sub)), 0))]
        chosen[sub] = head
        repeat[sub] = (docs[sub] != docs[lead]) | (starts[sub] != starts[lead])
    return repeat, chosen


def _by_group(docs, variants, starts, groups: int) -> list[tuple[int, bytes]]:
    """Marks packed by the group of their document; each document's are consecutive and sorted."""
    group = np.mod(docs, groups)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
    parts = [order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)])]
    return [(int(group[x[0]]), pack(docs[x], variants[x], starts[x], None)) for x in parts]


def _deal(held: list[tuple], keep: int, bits: int, groups: int) -> pa.RecordBatch:
    """Rows (bucket, windows) of one chunk, and (-1 - group, marks) for repeats known by now.

    held: tags, hashes, documents, variants and starts.  The lowest `keep` bits of a
    tag are not dealt yet; this pass deals by the highest `bits` of them.
    """
    tags, hashes, docs, variants, starts = (np.concatenate(x) for x in zip(*held))
    repeat, chosen = later(hashes, tags, docs, starts)
    rows = _by_group(docs[repeat], variants[repeat], starts[repeat], groups) if repeat.any() else []
    names, packed = [-1 - g for g, _ in rows], [x for _, x in rows]
    tags, hashes, docs, variants, starts = (x[chosen] for x in (tags, hashes, docs, variants, starts))
    bucket = (tags >> _U(keep - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(order)]):
        part = order[i:j]
        names.append(int(bucket[part[0]]))
        packed.append(pack(docs[part], variants[part], starts[part], hashes[part], tags[part] if keep > bits else None))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], schema=_PACKED)


def _hash_and_pack(width: int, total_bits: int, bits: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            variants = batch.column("variant").to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in doc_groups(offsets):
                part = data[offsets[lo] : offsets[hi]]
                begins, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
                words, ok = hash_words(part, begins, ends, False), inside(first, width)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                owner = np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(first))[at]
                tags = other_rolling(words, width)[at] >> _U(64 - total_bits)
                held.append((tags, rolling(words, width)[at], ids[owner], variants[owner], at - first[owner - lo]))
                count += len(at)
                if count >= CHUNK_WINDOWS:
                    yield _deal(held, total_bits, bits, groups)
                    held, count = [], 0
        if held:
            yield _deal(held, total_bits, bits, groups)

    return run


def _deal_again(keep: int, bits: int, groups: int):
    """Buckets, one after another, dealt by further bits; marks pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, bucket = [], 0, None
        for batch in batches:
            for name, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if name < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([packed], pa.binary())], schema=_PACKED)
                    continue
                if held and (name != bucket or count >= CHUNK_WINDOWS):
                    yield _deal(held, keep, bits, groups)
                    held, count = [], 0
                docs, variants, starts, hashes, tags = unpack(packed)
                held.append((tags, hashes, docs, variants, starts))
                bucket, count = name, count + len(docs)
        if held:
            yield _deal(held, keep, bits, groups)

    return run


def _count_bucket(groups: int):
    """A bucket's repeats; marks that are no bucket's pass through."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table([[-1 - bucket] * len(table), table.column("packed").to_pylist()], schema=_MARKS)
        docs, variants, starts, hashes, tags = (np.concatenate(x) for x in zip(*map(unpack, table.column("packed").to_pylist())))
        repeat, _ = later(hashes, tags, docs, starts)
        rows = _by_group(docs[repeat], variants[repeat], starts[repeat], groups) if repeat.any() else []
        return pa.table([[g for g, _ in rows], [x for _, x in rows]], schema=_MARKS)

    return run


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by windows that begin at `starts` (sorted)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    lo, hi = np.append(0, cut + 1), np.append(cut, len(starts) - 1)
    return [(int(starts[i]), int(starts[j]) + width) for i, j in zip(lo, hi)]


def _cut(width: int):
    """The rows of a group come marks first, then texts."""
    kind = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.list_(pa.int64()))), ("kept_text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, marks, ready = None, [], {}

        def settle() -> None:
            docs, variants, starts = (np.concatenate(x) for x in zip(*marks))
            order = np.lexsort((starts, variants, docs))
            docs, variants, starts = docs[order], variants[order], starts[order]
            cuts = np.flatnonzero(np.append(True, (np.diff(docs) != 0) | (np.diff(variants) != 0)))
            for i, j in zip(cuts, [*cuts[1:], len(docs)]):
                ready[int(docs[i]), int(variants[i])] = np.unique(starts[i:j])
            marks.clear()

        for batch in batches:
            rows: dict[str, list] = {c: [] for c in kind.names}
            columns = [batch.column(c).to_pylist() for c in ("group", "marks", "doc", "variant")]
            texts, shown = batch.column("text"), []
            for i, (g, packed, doc, variant) in enumerate(zip(*columns)):
                if g != group:
                    group, ready = g, {}
                    marks.clear()
                if packed is not None:
                    marks.append(unpack(packed)[:3])
                    continue
                if marks:
                    settle()
                words = (texts[i].as_py() or b"").split()
                spans = intervals(ready.get((doc, variant), ()), width)
                kept, at = [], 0
                for lo, hi in spans:
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                shown.append(i)
                for c, x in zip(kind.names, (len(words), len(words) - len(kept), spans, b" ".join(kept))):
                    rows[c].append(x)
            ids = batch.column("doc_id").take(pa.array(shown, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(rows[f.name], f.type) for f in kind]], names=["doc_id", *kind.names])

    return run


def _whole(docs: DataFrame) -> bool:
    """Whether ids are whole numbers that leave one free for rows without id."""
    if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return False
    return docs.where(F.col("doc_id") == _NAMELESS).isEmpty()


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, doc (a number in the order of ids), variant and text: rows that share a doc_id are numbered by text, if there are any."""
    docs = docs.select("doc_id", "text")
    if _whole(docs):
        base = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NAMELESS)))
    else:
        ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct().orderBy("id")
        ids = scratch.put(ids.withColumn("doc", F.monotonically_increasing_id()), "ids")
        base = docs.join(ids, docs["doc_id"] == ids["id"], "left").select("doc_id", "text", F.coalesce("doc", F.lit(_NAMELESS)).alias("doc"))
    shared = base.groupBy("doc").count().where("count > 1").select("doc")
    if shared.isEmpty():
        return base.withColumn("variant", F.lit(0))
    order = Window.partitionBy("doc").orderBy("h")
    texts = base.join(shared, "doc", "left_semi").select("doc", F.xxhash64("text").alias("h")).distinct()
    numbers = texts.withColumn("variant", F.row_number().over(order)).select(F.col("doc").alias("d"), "h", "variant")
    return base.join(numbers, (base["doc"] == numbers["d"]) & (F.xxhash64(base["text"]) == numbers["h"]), "left").select("doc_id", "doc", "text", F.coalesce("variant", F.lit(0)).alias("variant"))


def passes(total_bits: int) -> list[int]:
    """How many bits each pass deals by."""
    fan = FAN.bit_length() - 1
    return [fan] * (total_bits // fan) + ([total_bits % fan] if total_bits % fan else [])


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, intervals of removed words and kept_text (words joined by a space), a row for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = numbered(docs, Scratch(spark, "substring"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(total / 5 / BUCKET_WINDOWS).bit_length())
    groups = max(64, -(-total // GROUP_TEXT)) | 1
    first, *more = passes(bits)
    packed = docs.mapInArrow(_hash_and_pack(width, bits, first, groups), "bucket long, packed binary")
    dealt = first
    for step in more:
        packed = packed.repartition(1 << dealt, "bucket").sortWithinPartitions("bucket")
        packed = packed.mapInArrow(_deal_again(bits - dealt, step, groups), "bucket long, packed binary")
        dealt += step
    marks = packed.repartition(1 << min(bits, 17), "bucket").groupBy("bucket").applyInArrow(_count_bucket(groups), "group int, marks binary")
    marks = marks.select("group", "marks", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("int").alias("variant"), F.lit(None).cast("binary").alias("text"))
    texts = docs.select(F.pmod("doc", F.lit(groups)).cast("int").alias("group"), F.lit(None).cast("binary").alias("marks"), "doc_id", "doc", "variant", F.col("text").cast("binary").alias("text"))
    rows = marks.union(texts).repartition(min(groups, 1 << 17), "group").sortWithinPartitions("group", F.col("marks").isNull())
    out = rows.mapInArrow(_cut(width), f"doc_id {kind}, n_words long, n_removed long, intervals array<array<long>>, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
