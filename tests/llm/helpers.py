"""Small documents with the awkward cases every operator must stand, and brute-force readings of the contracts."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, hash long, place string, n long, key string"


def frame(spark, texts, sources=None, ids=None, langs=None):
    """Documents with extra columns whose names clash with those used inside operators."""
    rows = []
    for i, t in enumerate(texts):
        doc_id = ids[i] if ids else i
        rows.append((doc_id, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 2}", None, "clash", 1, "clash", 2, None))
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edited(text, seed, edits):
    r = random.Random(seed)
    out = text.split()
    for _ in range(edits):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return " ".join(out)
