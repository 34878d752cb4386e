import math
import re

from tests.llm.helpers import frame, prose
from vellumix.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
TEXTS = [
    None, "", "gnu general public LICENSE and GNU  General-Public_License", "xgnu general public license", "The MIT License. mit license", "CC BY-NC 4.0 cc by", prose(1, 500) + "\n" + MIT + "\n" + prose(2, 300),
    "Licensed under the Apache License, Version 2.0.", "license software permission copy", "All rights reserved.", "apache\nlicense", "é apache license é", "gnu general public", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
]


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), sorted({label for _, label in found})


def test_base_against_brute_force_and_added_labels(spark):
    out = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert out[6].labels == ["mit"] and out[6].base_labels == [] and out[6].score >= licenses.SUPPORT
    assert out[5].labels == ["cc-by", "cc-by-nc"] and out[9].labels == ["reserved"] and out[13].labels == ["bsd-2-clause"]
    assert out[8].labels == [] and out[8].score == 0
    full = licenses.scan_licenses(frame(spark, ["Licensed under CC BY-NC 4.0."])).first()
    assert full.labels == ["cc-by", "cc-by-nc"]


def test_mandatory_phrase_and_empty_table(spark):
    broken = MIT.replace("free of charge", "for a fee")
    assert licenses.scan_licenses(frame(spark, [broken])).first().labels == []
    assert licenses.scan_licenses(frame(spark, ["a"]).limit(0)).count() == 0


def test_order_of_notices_does_not_matter(spark):
    by, sa, nc = (f"This work is licensed under a Creative Commons Attribution{x} 4.0 International License." for x in ("", "-ShareAlike", "-NonCommercial"))
    gap = f" {prose(3, 60)} "
    texts = [gap.join(x) for x in ((sa, by), (by, sa), (nc, by), (by, nc), (sa, nc, by), (sa,), (sa, sa))]
    out = {r.doc_id: set(r.labels) for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    both, other = {"cc-by", "cc-by-sa"}, {"cc-by", "cc-by-nc"}
    assert [out[i] for i in range(7)] == [both, both, other, other, both | other, {"cc-by-sa"}, {"cc-by-sa"}]


def test_weights_count_every_row(spark):
    text = "CASE WHEN id % 3 = 0 THEN 'Software software, x' WHEN id % 5 = 0 THEN concat('a LICENSE ', id) WHEN id % 7 > 0 THEN concat('w', id) END"
    docs = spark.range(0, 30_000, 1, 7).selectExpr("id AS doc_id", f"{text} AS text")
    weight = licenses.weights(docs)
    named = lambda word: weight[int(licenses.words_of(word.encode())[0])]
    assert [named("software"), named("license"), named("warranty")] == [math.log(30_002 / (n + 1)) for n in (10_000, 4_000, 0)]
