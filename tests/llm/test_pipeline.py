import corpus_pipeline
from tests.llm.helpers import edited, frame, prose
from tests.llm.test_decontam import ITEM, bench
from tests.llm.test_langid import sample


def test_every_stage_decides(spark, tmp_path):
    texts, langs = sample(200, 9)
    copy, near = prose(1, 150), edited(prose(2, 150), 3, 1)
    texts += [copy, copy, prose(2, 150), near, f"the of and to in {ITEM} that with from the of", "123 456", None, ""]
    langs += ["en"] * 8
    texts = [f"{t}\nShare this page" if t and i % 3 == 0 and i < 200 else t for i, t in enumerate(texts)]
    docs = frame(spark, texts, ["h"] * len(texts), langs=langs).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, [(1, ITEM)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    now, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts[name] = {r.doc_id for r in now.select("doc_id").collect()}
    ids = set(range(len(texts)))
    assert ids - counts["language_id"] >= {205, 206, 207} and len(ids - counts["language_id"]) <= 8
    assert counts["line_dedup"] == counts["language_id"]
    assert not [r for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect() if "Share this" in r.text]
    for pair in ({200, 201}, {202, 203}):
        if pair <= counts["line_dedup"]:
            assert counts["minhash_neardup"] & pair == {min(pair)}
    assert 204 not in counts["decontamination"]
    assert counts["source_mixing"] == counts["decontamination"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == counts["source_mixing"]


def test_stages_hand_python_few_texts_at_once(spark, tmp_path, monkeypatch):
    texts = [prose(i, 30) for i in range(1500)]
    frame(spark, texts, langs=["en", "fr"] * 750).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, texts[i]) for i in range(600)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kind, plain = type(docs), type(docs).mapInArrow

    def bounded(self, run, *more):
        def checked(batches):
            def seen():
                for batch in batches:
                    assert batch.num_rows <= 512, batch.num_rows
                    yield batch

            return run(seen())

        return plain(self, checked, *more)

    monkeypatch.setattr(kind, "mapInArrow", bounded)
    assert corpus_pipeline.identify_languages(spark, docs, str(tmp_path)).count() == 1500
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 900
