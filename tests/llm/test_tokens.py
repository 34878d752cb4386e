import numpy as np
import pyarrow as pa

from tests.llm.helpers import prose, words
from vellumix.llm import setsketch, tokens


def test_words_and_windows_match_plain_python(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 64)
    texts = ["a b  c\t\nd", None, "", "   ", "é ü x", "a b c d", prose(1, 300), "x"]
    column = pa.array(texts)
    got = {}
    for lo, hi, hashes, first in tokens.word_hashes(column):
        for i in range(lo, hi):
            got[i] = hashes[first[i - lo] : first[i - lo + 1]].tolist()
    assert [len(got[i]) for i in range(len(texts))] == [len(words(t)) for t in texts]
    by_word = {}
    for i, t in enumerate(texts):
        for w, h in zip(words(t), got[i]):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    runs = tokens.rolling(np.array(got[6], np.uint64), 3)
    again = tokens.rolling(np.array(got[6][10:13], np.uint64), 3)
    assert runs[10] == again[0] and len(runs) == 298


def test_slices_and_case():
    column = pa.array(["zzz", "Ab É", "ab É"]).slice(1)
    rows = list(tokens.shingle_sets(column, 3))
    assert rows[0][1].tolist() == rows[1][1].tolist() and len(rows[0][1]) == 1


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(3)
    pool = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[500:2500]
    m = 512
    both = np.unique(np.concatenate([a, b]))
    x, y, z = (setsketch.registers(s, np.array([0]), m) for s in (a, b, both))
    assert (setsketch.merged(x, y) == z).all()
    est = setsketch.joint_similarity(x, y, np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 1500 / 2500) < 0.1
    same = setsketch.joint_similarity(x, x, np.array([2000.0]), np.array([2000.0]))[0]
    assert same > 0.99
