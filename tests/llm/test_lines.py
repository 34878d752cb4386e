from collections import Counter, defaultdict

from tests.llm.helpers import frame
from vellumix.llm import lines


def test_against_brute_force(spark):
    texts, sources = [], []
    for i in range(120):
        own = [f"line {i}", "", "rare" if i % 40 == 0 else f"x{i}"]
        if i % 3 == 0:
            own += ["Menu", "  ", "Menu"]
        texts.append("\n".join(own))
        sources.append(("a", "b", None)[i % 7 % 3])
    texts += [None, "", "Menu\nMenu", "\n\n"]
    sources += ["a", "a", "a", None]
    pages, seen = Counter(sources), defaultdict(set)
    for i, (t, s) in enumerate(zip(texts, sources)):
        for line in (t or "").split("\n"):
            if line.strip():
                seen[s, line].add(i)
    gone = {k for k, ids in seen.items() if len(ids) >= 10 and len(ids) > pages[k[0]] * 0.1}
    assert gone
    docs = frame(spark, texts, sources)
    out = {r.doc_id: r for r in lines.drop_boilerplate(docs, counted=True).collect()}
    for i, (t, s) in enumerate(zip(texts, sources)):
        kept = None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in gone)
        assert out[i].text == kept
        assert out[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert out[i].n_dropped == (0 if t is None else sum((s, x) in gone for x in t.split("\n")))
    assert lines.drop_boilerplate(docs).schema == docs.schema


def test_repeats_and_empty_tables(spark):
    docs = frame(spark, ["same\nown"] * 12, ["h"] * 12, ids=[1] * 12)
    assert {r.text for r in lines.drop_boilerplate(docs).collect()} == {""}
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0
    assert {r.text for r in lines.drop_boilerplate(docs, least_pages=13).collect()} == {"same\nown"}
