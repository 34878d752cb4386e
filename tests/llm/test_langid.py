import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from vellumix.llm import langid

WORDS = {"en": "the of and to in that with from".split(), "de": "der die und nicht auf für ein ist".split(), "fr": "le les des une que dans être à".split()}


def sample(n, seed):
    r = random.Random(seed)
    langs = [r.choice(sorted(WORDS)) for _ in range(n)]
    return [" ".join(r.choice(WORDS[s]) for _ in range(r.randint(20, 120))) for s in langs], langs


def test_learns_and_predicts_whole_texts(spark):
    texts, langs = sample(240, 1)
    odd = [None, "", "123 --- 456", "²³", "der die und nicht auf für ein ist", " ".join(["der die und nicht"] * 4000)]
    docs = frame(spark, texts + odd, langs=langs + [None] * len(odd))
    net = langid.fit(docs.where(~langid.held_out()))
    rows = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    held = [i for i in range(240) if rows[i].held_out]
    assert len(held) > 20 and all(0 <= r.score <= 1 for r in rows.values())
    assert np.mean([rows[i].lang_pred == langs[i] for i in held]) >= 0.95
    assert [rows[240 + i].lang_pred for i in range(4)] == ["und"] * 4 and rows[240].score == 0
    assert rows[244].lang_pred == rows[245].lang_pred == "de"
    again = langid.fit(docs.where(~langid.held_out()).repartition(5))
    assert np.allclose(again.out, net.out)
    kept = langid.keep_known(docs, net)
    assert kept.schema == docs.schema and kept.count() == 242


def test_noise_is_rejected_and_languages_stay(spark):
    texts, langs = sample(300, 4)
    odd = ["der die und nicht 4845168114407329 auf für ein ist", "THE OF AND TO IN THAT!! WITH FROM THE", "the of and 10.0.0.1 to in that"]
    junk = [b.decode(errors="ignore") for b in langid.noise(60, 77, "".join(texts))] + ["съешь же ещё этих мягких французских булок да выпей чаю " * 3, "a9F/" * 60, "{" * 100 + "x", None, "", "42"]
    docs = frame(spark, texts + odd + junk, langs=langs + [None] * (len(odd) + len(junk)))
    kept = {r.doc_id for r in langid.keep_known(docs, langid.fit_rejecting(docs)).collect()}
    assert kept >= set(range(303)) and len(kept) <= 303 + 3


def test_rare_languages_are_learned(spark):
    texts, langs = sample(200, 6)
    rare = [" ".join(["kaj", "estas", "la", "ĉiuj", "homoj", "denaske"][i % 6 :] * 9) for i in range(12)]
    docs = frame(spark, texts + rare, langs=langs + ["eo"] * 12)
    net = langid.fit(docs, sample_rows=40)
    assert "eo" in net.languages
    assert [r.lang_pred for r in langid.predict(frame(spark, rare), net).collect()].count("eo") >= 10


def test_only_the_text_counts(spark):
    texts, langs = sample(60, 2)
    net = langid.fit(frame(spark, texts, langs=langs))
    a = langid.predict(frame(spark, texts, langs=langs), net).select("lang_pred", "score").collect()
    b = langid.predict(frame(spark, texts, langs=[None] * 60, sources=[None] * 60), net).select("lang_pred", "score").collect()
    assert a == b


def test_pairs_of_bytes_give_the_same_network():
    texts, langs = sample(30, 3)
    net = langid.train([t.encode() for t in texts], langs, epochs=1)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    x, owner = langid.windows(data, np.array([0, 300, 300, 310, len(data)]))
    assert set(owner) == {0, 2, 3} and (x[owner == 2][:, 10:] == 0).all()
    slow = net.probabilities(net.responses(x.astype(np.intp))[0])
    assert np.allclose(slow, net.paired().probabilities(x), atol=1e-5)


def test_plain_convolution_gives_the_same():
    texts, langs = sample(20, 5)
    net = langid.train([t.encode() for t in texts], langs, epochs=1)
    x, _ = langid.windows(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0].encode())]))
    for row in x:
        hidden = [max(sum(table[j][row[at + j]][f] for j in range(width)) for at in range(langid.WINDOW - width + 1)) for width, table in net.tables.items() for f in range(langid.FILTERS)]
        assert np.allclose(net.probabilities(np.array([hidden])), net.paired().probabilities(row[None]), atol=1e-5)


def test_nothing_to_learn_from(spark):
    docs = frame(spark, ["some text", None], langs=[None, None])
    assert langid.fit(docs) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), None).count() == 0


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
