import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose, sha, words
from vellumix.llm import substring


def brute(texts, ids, width):
    """(n_words, n_removed, kept) per row; windows of rows that share a doc_id and start are equally early."""
    first = {}
    rows = [(ids[i] if ids[i] is not None else float("-inf"), words(t)) for i, t in enumerate(texts)]
    for d, w in rows:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, (d, k)), (d, k))
    out = []
    for d, w in rows:
        cut = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (d, k):
                cut[k : k + width] = [True] * width
        out.append((len(w), sum(cut), " ".join(x for x, c in zip(w, cut) if not c)))
    return out


def check(spark, texts, ids, width=20, **patch):
    got = substring.remove_repeats(frame(spark, texts, ids=ids), width).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s")).collect()
    want = [(d, n, r, sha(k)) for d, (n, r, k) in zip(ids, brute(texts, ids, width))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_against_brute_force(spark):
    passage = prose(99, 60)
    loop = " ".join(["tick tock"] * 40)
    texts = [prose(1, 100), f"{prose(2, 30)} {passage} {prose(3, 10)}", f"{passage} {prose(4, 25)}", passage, loop, prose(1, 100), None, "", "one two", f"{prose(5, 19)}", f"{prose(5, 19)}", f"{prose(6, 20)}", f"{prose(6, 20)}"]
    check(spark, texts, [*range(20, 20 + len(texts))])


def test_shared_and_missing_ids(spark):
    passage = prose(7, 40)
    texts = [f"{passage} tail", f"lead {passage}", passage, passage, passage, prose(8, 50)]
    check(spark, texts, [5, 5, None, None, 3, 5])


def test_empty_table(spark):
    assert substring.remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0


def test_small_chunks_and_buckets_agree(spark, monkeypatch):
    passage = prose(17, 45)
    texts = [f"{prose(i, 10)} {passage} {prose(i + 50, 8)}" for i in range(12)]
    monkeypatch.setattr(substring, "CHUNK_WINDOWS", 30)
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 1)
    monkeypatch.setattr(substring, "GROUP_TEXT", 50)
    check(spark, texts, list(range(12)), 5)
    monkeypatch.setattr(substring, "FAN", 4)
    assert substring.passes(7) == [2, 2, 2, 1]
    check(spark, texts, list(range(12)), 5)


def test_equal_hashes_with_unequal_tags():
    hashes, tags = np.array([5, 5, 5, 5], np.uint64), np.array([1, 2, 1, 2], np.uint64)
    repeat, chosen = substring.later(hashes, tags, np.array([1, 2, 3, 4]), np.zeros(4, int))
    assert repeat.tolist() == [False, False, True, True] and chosen.tolist() == [True, True, False, False]


def test_ids_of_other_kinds_and_the_least_number(spark):
    passage = prose(31, 40)
    texts = [f"{passage} z", f"{passage} a", passage, None]
    rows = spark.createDataFrame(list(zip(["b", "a", None, "c"], texts)), "doc_id string, text string")
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(rows).collect()}
    assert got == {None: 0, "a": 40, "b": 40, "c": 0}
    check(spark, [passage, passage, passage], [-(1 << 63), None, 7])


def test_packing_round_trip():
    docs = np.array([9, 9, 9, -4, 7, 7], np.int64)
    variants = np.array([0, 0, 1, 0, 0, 0], np.int32)
    starts = np.array([3, 900_000, 2, 0, 5, 6])
    hashes = np.arange(6, dtype=np.uint64) * np.uint64(0xF102030405060708)
    d, v, s, h, t = substring.unpack(substring.pack(docs, variants, starts, hashes, hashes[::-1].copy()))
    assert (d == docs).all() and (v == variants).all() and (s == starts).all() and (h == hashes).all() and (t == hashes[::-1]).all()
    assert not substring.unpack(substring.pack(docs, variants, starts, None))[3].any()


def test_intervals():
    assert substring.intervals(np.array([0, 1, 20, 45]), 20) == [(0, 40), (45, 65)]
    assert substring.intervals(np.array([], int), 20) == []
