"""Personal data in whole texts: exact patterns, and scored candidates for what they miss.

Base spans come from four patterns with checks.  Generators of high recall propose
further, overlapping spans: addresses spelled out ("name at host dot com"),
national phone numbers, grouped or mistyped card numbers, IPv6 addresses also in
short form.  Boosted
trees over the candidate's form and the words around it give a calibrated
probability; candidates at or over their kind's threshold that overlap no base span
and no likelier candidate become spans of their kind.  The trees are fitted on the
driver on generated, labelled examples with a fixed seed, and applied as one SQL
expression; no Python runs on executors.  Spans of one kind don't overlap each
other, so what a candidate overlaps is found by halving, whatever their number.

Nulls and ties: a null text has no spans and the digest of an empty list.  A row
is judged by its text alone, so repeated rows get equal results.  Equal starts are
ordered by kind as listed, then end.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vellumix.llm.boosting import Boosted, fit
from vellumix.llm.spans import all_matches, indexed, joined, labelled, let, meets, overlapping

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the contract's patterns; a run is entered at its first character or where the last match ended, so no text takes quadratic time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_GROUP = "[0-9A-Fa-f]{1,4}"
_AT, _DOT = "[Aa][Tt]", "[Dd][Oo][Tt]"
_LABEL = "[A-Za-z0-9-]"
#: Generators: kind and a pattern that both Java and Python read alike.
GENERATORS = (
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?: ?(?:\({_AT}\)|\[{_AT}\]| {_AT} ) ?{_LABEL}{{1,63}}(?: ?(?:\({_DOT}\)|\[{_DOT}\]| {_DOT} |\.) ?{_LABEL}{{2,63}}){{1,4}}| ?@ ?{_LABEL}{{1,63}}(?:\.{_LABEL}{{1,63}}){{0,3}}(?: ?(?:\({_DOT}\)|\[{_DOT}\]| {_DOT} ) ?{_LABEL}{{2,63}}){{1,4}})"),
    ("ip", rf"(?<![0-9A-Za-z:])(?:(?:{_GROUP}:){{4,7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{4}(?:[./ -][0-9]{4}){2}[./ -][0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])[0-9]{4}[./ -][0-9]{6}[./ -][0-9]{5}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])[0-9]{13,19}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z.+(/-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,5}|1(?=[ .-][0-9]{3}[ .-])|[6-9][0-9]{1,2}(?=[ .-]))(?:[ ./-]?[0-9]{2,8}+){1,5}(?![0-9A-Za-z-])"),
)
#: What a text must hold for a kind's base pattern or generator to match at all.
_GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_WIDE_GUARD = {"email": rf"@|[ (\[]{_AT}[ )\]]", "ip": "::|:[0-9A-Fa-f]{1,4}:", "card": "[0-9]{4}", "phone": "[0-9]{2}"}
_BEFORE, _AFTER = 24, 12
#: Words near a candidate that speak for its kind, or against any.
CONTEXT = {
    "email": "mail|contact|write|reach|address|courriel|correo|schreib",
    "ip": "ip|host|server|addr|ping|connect",
    "card": "card|visa|credit|master|debit|pay|cc|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|cell|contact|dial|ruf|appel|llam",
    "against": "order|invoice|item|ref|isbn|part|serial|version|ticket|code|no\\.|sku|id|commande|bestell|pedido",
}
_SPELLED = r"[(\[](?:at|dot)[)\]]| dot "
FEATURES = ["rank", "length", "digits", "distinct_digits", "separators", "luhn", "brackets", "spelled", "for_kind", "against"]


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def one(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(places, one), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _holds(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.when(F.length(_digits(found)).between(12, 19), let(_digits(found), _luhn)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _proposed(kind: str, found: Column) -> Column:
    """Whether a generator's match can be of its kind at all."""
    if kind == "phone":
        return F.length(_digits(found)).between(7, 15)
    if kind == "ip":
        return F.length(found) > 3
    return F.lit(True)


def _base(text: Column) -> Column:
    """For each kind, array<struct<start,rank,end,kind>> of its pattern's checked matches."""

    def checked(found: Column) -> Column:
        of = lambda i, kind: labelled(F.filter(F.get(found, F.lit(i)), lambda s: _holds(kind, s["text"])), kind, i)
        return F.array(*[of(i, kind) for i, kind in enumerate(KINDS)])

    return let(all_matches(text, [(BASE[k], text.rlike(_GUARD[k])) for k in KINDS]), checked)


def base_spans(text: Column) -> Column:
    """array<struct<start,rank,end,kind>> of the four patterns' checked matches."""
    return F.array_sort(F.flatten(_base(text)))


def _features(rank: Column, found: Column, digits: Column, near: Column) -> dict[str, Column]:
    own = F.lit(0)
    for i, k in enumerate(KINDS):
        own = F.when(rank == i, near.rlike(CONTEXT[k]).cast("int")).otherwise(own)
    return {
        "rank": rank,
        "length": F.length(found),
        "digits": F.length(digits),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))),
        "separators": F.length(F.regexp_replace(found, r"[^ ./:-]", "")),
        "luhn": F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False).cast("int"),
        "brackets": found.rlike(r"[(\[]").cast("int"),
        "spelled": F.lower(found).rlike(_SPELLED).cast("int"),
        "for_kind": own,
        "against": near.rlike(CONTEXT["against"]).cast("int"),
    }


def _features_of(rank: int, found: str, before: str, after: str) -> list[float]:
    """The same features of one example, for fitting."""
    digits = re.sub("[^0-9]+", "", found)
    near = f"{before} {after}".lower()
    double = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits)))
    return [
        rank, len(found), len(digits), max(1, len(set(digits))), len(re.sub(r"[^ ./:-]", "", found)),
        int(12 <= len(digits) <= 19 and double % 10 == 0), int(bool(re.search(r"[(\[]", found))),
        int(bool(re.search(_SPELLED, found.lower()))), int(bool(re.search(CONTEXT[KINDS[rank]], near))), int(bool(re.search(CONTEXT["against"], near))),
    ]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates of each kind, true and false, with words around them in four languages."""
    r = random.Random(seed)
    words = "the of and when near over under about since part plain house river der und mit auf le de la une pour el los una con".split()
    pro = {"email": ["mail", "contact", "write to", "reach", "courriel", "correo", "schreiben an"], "ip": ["server", "host", "ping", "serveur"], "card": ["card", "visa", "pay by", "carte", "Karte", "tarjeta"], "phone": ["phone", "call", "tel", "fax", "rufen", "appeler", "llame al"]}
    contra = ["order", "invoice", "item", "ref", "serial", "ticket", "code", "commande", "Bestellung", "pedido"]
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def syllables(k: int) -> str:
        return "".join(r.choice("an er the on is at re in ou st le ka mi".split()) for _ in range(k))

    def card() -> str:
        body = "4" + number(14)
        for last in "0123456789":
            if _features_of(2, body + last, "", "")[5]:
                return body + last
        return body

    rows, labels = [], []
    for _ in range(n):
        rank = r.randrange(4)
        kind, true = KINDS[rank], r.random() < 0.5
        if kind == "email":
            name, host, end = (syllables(r.randrange(1, 5)) for _ in range(3))
            gap = r.choice(["", " "])
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), ("[at]", ".")])
            if true:
                if r.random() < 0.25:
                    at, dot = r.choice(["@", " @ "]), r.choice(["(dot)", "[dot]", " dot "])
                found = f"{name}{gap if at[0] in '([' else ''}{at}{host}{dot}{r.choice(['com', 'org', 'net', 'io', 'edu'])}"
                found = found.upper() if r.random() < 0.2 else found
            else:
                found = f"{name} at {host}{r.choice(['. ', ' . ', '.'])}{end.title()}" + r.choice(["", ". " + syllables(2).title()])
        elif kind == "ip":
            groups = [f"{r.randrange(1 << 16):x}" for _ in range(8)]
            if true and r.random() < 0.5:  # a run of zeros left out
                lead_, rest = r.randrange(1, 5), r.randrange(0, 4)
                groups = [r.choice(["2001:db8", "fe80", "2a02"]), *groups[1:lead_], *([""] if rest else ["", ""]), *[r.choice([g, "1"]) for g in groups[5 : 5 + rest]]]
            found = ":".join(groups) if true else r.choice([":".join(number(2) for _ in range(r.choice([5, 6]))), f"{number(2)}::{number(2)}", f"{r.choice('abcdef')}::{r.choice('abcdef')}"])
        elif kind == "card":
            c = card()
            sep = r.choice("./")
            spaced = r.choice(" -")
            mistyped = r.choice([spaced.join(number(4) for _ in range(4)), spaced.join(number(k) for k in (4, 6, 5))])
            if r.random() < 0.25:  # digits that fail the check, so only the words around them tell
                found = mistyped
            else:
                whole = r.random() < 0.4  # beside another number, so the exact pattern reads both as one
                found = c if true and whole else sep.join(c[i : i + 4] for i in range(0, 16, 4)) if true else r.choice([number(16), number(13), sep.join(number(4) for _ in range(4))])
        else:
            found = r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(number(3), number(3), number(4))
            if r.random() < 0.5:  # other countries' groups
                gap = r.choice(" .-")
                sizes = r.choice([(3, 4, 4), (2, 2, 2, 2, 2), (4, 2, 6), (4, 6), (3, 7), (5, 6), (1, 3, 3, 4), (2, 3, 2, 2), (3, 3, 3), (10,)])
                groups = [number(k) for k in sizes]
                groups[0] = ("1" if sizes[0] == 1 else r.choice("6789") if sizes == (2, 3, 2, 2) or sizes == (3, 3, 3) else "0") + groups[0][1:]
                found = gap.join(groups)
        lead = r.choice(pro[kind]) if true and (kind == "phone" or (kind == "card" and found == mistyped) or r.random() < 0.7) else r.choice(contra) if not true and r.random() < 0.5 else r.choice(words)
        after = r.choice(words)
        if not true and (kind == "phone" or (kind == "card" and found == mistyped)) and re.search(CONTEXT[kind], lead):
            continue
        rows.append(_features_of(rank, found, f"{lead} ", after))
        labels.append(true)
    return np.array(rows, float), np.array(labels)


@lru_cache(maxsize=1)
def model() -> Boosted:
    x, y = _examples(2400, 11)
    return fit(FEATURES, x, y, groups=x[:, 0])


def candidates(text: Column) -> Column:
    """For each kind, array<struct<start,rank,end,kind,score>> of its generator's proposals."""
    scorer = model()
    names = F.array(*[F.lit(k) for k in KINDS])

    def one(s: Column) -> Column:
        near = F.lower(F.concat(s["before"], F.lit(" "), s["after"]))

        def form(own: Column) -> Column:
            return F.struct(*[c.alias(n) for n, c in _features(s["rank"], s["text"], own["digits"], own["near"]).items()])

        seen = F.struct(_digits(s["text"]).alias("digits"), near.alias("near"))
        score = let(let(seen, form), lambda f: scorer.column({n: f[n] for n in FEATURES}))
        return F.struct(s["start"], s["rank"], s["end"], F.get(names, s["rank"]).alias("kind"), score.alias("score"))

    def scored(found: Column) -> Column:
        able = lambda i, kind: F.filter(F.get(found, F.lit(i)), lambda s: _proposed(kind, s["text"]))
        named = lambda i, kind: F.transform(able(i, kind), lambda s: F.struct(s["start"], F.lit(i).alias("rank"), s["end"], s["text"], s["before"], s["after"]))
        return F.transform(F.array(*[named(i, kind) for i, kind in enumerate(KINDS)]), lambda spans: F.transform(spans, one))

    return let(all_matches(text, [(pattern, text.rlike(_WIDE_GUARD[kind])) for kind, pattern in GENERATORS], (_BEFORE, _AFTER)), scored)


def _chosen(base: Column, proposed: Column) -> Column:
    """Proposals at or over their kind's threshold, clear of base spans and of better proposals."""
    limits = F.array(*[F.lit(model().thresholds[i]) for i in range(len(KINDS))])
    before = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (F.struct(a["start"], a["rank"], a["end"]) < F.struct(b["start"], b["rank"], b["end"])))

    def clear(known: Column) -> Column:
        return F.transform(proposed, lambda spans: F.filter(spans, lambda s: (s["score"] >= F.get(limits, s["rank"])) & ~meets(known, s)))

    def settle(likely: Column) -> Column:
        best = lambda index: F.flatten(F.transform(likely, lambda spans: F.filter(spans, lambda s: ~F.exists(index, lambda i: F.exists(overlapping(i, s), lambda o: before(o, s))))))
        return F.transform(let(indexed(likely), best), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))

    return let(let(indexed(base), clear), settle)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans (arrays of start, rank, end, kind; code points), a row for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def both(base: Column) -> Column:
        some = let(candidates(text), lambda proposed: F.when(F.size(F.flatten(proposed)) > 0, _chosen(base, proposed)).otherwise(none))
        return F.struct(F.array_sort(F.flatten(base)).alias("base"), F.array_sort(F.concat(F.flatten(base), some)).alias("spans"))

    return docs.select("doc_id", let(_base(text), both).alias("s")).select("doc_id", "s.base", "s.spans")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are cut once."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        lead = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], lead, mark).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
