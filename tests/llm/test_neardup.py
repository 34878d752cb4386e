import itertools

import numpy as np

from tests.llm.helpers import edited, frame, prose, words
from vellumix.llm import neardup, setsketch
from vellumix.llm.components import components, near_labels
from vellumix.llm.scratch import Scratch


def lowered(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(text)]


def brute(texts, ids, k, num, den):
    sets = []
    for t in texts:
        w = lowered(t)
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(root(i)) if sets[i] else ids[i]) for i in range(len(texts))]


def check(spark, texts, ids, k=3, num=85, den=100):
    got = neardup.near_duplicates(frame(spark, texts, ids=ids), k, num, den).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(texts, ids, k, num, den), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_against_brute_force(spark):
    base = prose(1, 120)
    texts = [base, base.upper(), edited(base, 1, 1), edited(base, 2, 2), edited(base, 3, 9), prose(2, 80), None, "", "One two", "one TWO", "one", prose(3, 90), edited(prose(3, 90), 5, 1)]
    chain = prose(4, 200)
    for i in range(5):
        chain = edited(chain, 10 + i, 3)
        texts.append(chain)
    check(spark, texts, [(i * 37) % 101 for i in range(len(texts))])


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = prose(5, 60)
    texts = [edited(base, i, i % 5) for i in range(40)] + [prose(50 + i, 60) for i in range(10)]
    check(spark, texts, list(range(100, 150)))


def test_very_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 3000)
    base = prose(41, 4000)
    texts = [edited(base, i, 40 * i) for i in range(7)] + [prose(60 + i, 900) for i in range(3)]
    check(spark, texts, list(range(len(texts))))


def test_estimate_keeps_true_pairs():
    r = np.random.default_rng(3)
    n, x, y = 2000, [], []
    for _ in range(400):
        pool = r.integers(0, 1 << 63, n, dtype=np.uint64)
        x.append(np.unique(pool[: n - 160]))
        y.append(np.unique(pool[160:]))
    m = neardup.BANDS * neardup.ROWS
    sketch = lambda sets: setsketch.registers(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]]), m)
    size = np.full(400, n - 160)
    estimate = setsketch.joint_similarity(sketch(x), sketch(y), size, size)
    true = (n - 320) / n
    assert abs(estimate.mean() - true) < 0.02 and estimate.min() > true - neardup.SLACK + 0.1


def test_missing_shared_ids_and_repeats(spark):
    a, b = prose(6, 50), prose(7, 50)
    check(spark, [a, a, b, b, a], [None, 4, None, None, 4])


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (200, 203)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in components(edges, scratch).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100} | {n: 200 for n in range(200, 204)}
    assert got == want
    near = {r.node: r.root for r in near_labels(edges, scratch).collect()}
    assert all(want[n] <= r <= n and want[r] == want[n] for n, r in near.items())
