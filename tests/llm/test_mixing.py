from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose, words
from vellumix.llm import mixing


def waterfill(sizes):
    """Targets by the contract's words: share by weight, cap, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_takes(spark):
    texts = [prose(i, 5 + i * 7 % 90) for i in range(60)] + [None, "", "   ", prose(0, 5)]
    sources = [("a", "b", "c", None, "é")[i % 5] for i in range(63)] + ["a"]
    ids = [*range(60), None, 61, 62, 0]
    out = mixing.mix(frame(spark, texts, sources, ids)).collect()
    assert len(out) == 64
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(words(t))
    want = waterfill(sizes)
    by_sizes = {(sizes[s], round(t, 6)): s for s, t in want.items()}
    assert len(by_sizes) == 5
    taken = defaultdict(int)
    for r in out:
        s = by_sizes[r.source_size, round(r.target, 6)]
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
        taken[s] += r.taken
    assert {s: taken[s] for s in want} == {s: int(want[s] + 1e-9) for s in want}
    placed = [r.position for r in out if r.position is not None]
    assert placed == sorted(placed) and 0 <= min(placed) <= max(placed) <= 1
    again = mixing.mix(frame(spark, texts, sources, ids).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_every_pass_follows_the_schedule(spark):
    def demand(t, knots):
        area = lambda t: sum((min(max(t, a), b) - a) * (u + u + (v - u) * (min(max(t, a), b) - a) / (b - a)) / 2 for (a, u), (b, v) in zip(knots, knots[1:]))
        return area(t) / area(1.0)

    docs = frame(spark, [prose(i, 20 + i % 30) for i in range(240)], ["abc"[i % 3] for i in range(240)])
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    source = {i: "abc"[i % 3] for i in range(240)}
    target = {source[r.doc_id]: r.target for r in rows}
    assert all(sum(p.taken for p in r.schedule) == r.taken and (r.position == r.schedule[0].position if r.schedule else r.position is None) for r in rows)
    assert max(len(r.schedule) for r in rows) == 2
    passes = mixing.by_pass(mixed).collect()
    assert [p.position for p in passes] == sorted(p.position for p in passes)
    before = defaultdict(int)
    for p in passes:
        s = source[p.doc_id]
        assert before[s] / target[s] == pytest.approx(demand(p.position, mixing.SCHEDULES["abc".index(s)]), abs=1e-6)
        before[s] += p.taken
    assert all(before[s] == int(target[s] + 1e-9) for s in target)


def test_empty_table_and_wordless_sources(spark):
    docs = frame(spark, ["", None], ["a", "b"])
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_time_inverts_the_integral(spark, knots):
    def area(t):
        total = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            hi = min(max(t, a), b)
            w = u + (v - u) * (hi - a) / (b - a)
            total += (hi - a) * (u + w) / 2
        return total

    rows = spark.range(0, 21).select((F.col("id") / 20).alias("u")).select("u", mixing.time_of(F.col("u"), knots).alias("t")).collect()
    for r in rows:
        assert area(r.t) / area(1.0) == pytest.approx(r.u, abs=1e-9)
