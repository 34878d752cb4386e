import random
import re
from collections import Counter, defaultdict

from tests.llm.helpers import frame, prose
from vellumix.llm import decontam

ITEM = "Anna has 12 apples and buys 30 kg of flour for Peter on the way to the old market near town"


def bench(spark, items):
    return spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")


def found(spark, texts, items, **kw):
    return {(r.doc_id, r.item) for r in decontam.contaminated(frame(spark, texts), bench(spark, items), **kw).collect()}


def test_copies_and_new_parameters(spark):
    other = prose(5, 30)
    asked_again = ITEM.replace("12", "7").replace("30 kg", "45 lb").replace("Anna", "Maria").replace("Peter", "Hugo")
    inconsistent = "Anna has 12 apples and buys 30 kg of flour. Then Peter said nothing else of use at all"
    texts = [f"{prose(1, 40)} {ITEM}. {prose(2, 40)}", f"{prose(3, 10)} {asked_again}", prose(4, 200), None, "", "12 apples", inconsistent, f"x {other.upper()} y", other]
    got = found(spark, texts, [(1, ITEM), (2, other), (3, None), (4, "too short")])
    assert {(0, 1), (1, 1), (8, 2)} <= got and not {d for d, _ in got} & {2, 3, 4, 5, 6}


def test_copies_in_other_letter_case(spark):
    other = "Große Äpfel aus Österreich kosten im März 12 Euro und Ömer Müßig kauft sie nicht"
    texts = [ITEM.upper(), ITEM.lower(), f"x y {ITEM.upper()} z", other.upper(), other.lower(), prose(9, 40).upper()]
    got = found(spark, texts, [(1, ITEM), (2, other)])
    assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)}


def test_dense_slots_and_short_items(spark):
    items = {1: "What is 15 plus 27 times 3 minus 8", 2: "Anna Smith paid 12 dollars and Peter Jones paid 15 euros for 3 kg", 3: "Anna paid 12 dollars, Peter 15 euros", 4: "who wrote Faust", 5: "a 1 2 3 4 5 6 7 b 8 9 c", 6: "1 2 3 4 5 6"}
    texts = [
        "so: What is 41 plus 66 times 9 minus 2 then", "Maria Lopez paid 99 dollars and Hugo Bauer paid 40 euros for 8 kg", "x Maria paid 7 dollars, Hugo 8 euros y", "He asked WHO WROTE FAUST today",
        "a 9 8 7 6 5 4 3 b 2 1 c", "9 8 7 6 5 4", "1 2 3 4 5 6", "What is 41 minus 66 plus 9 times 2", "who wrote", *[prose(i, 60) for i in range(4)],
    ]
    assert found(spark, texts, list(items.items())) == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 6)}


def test_dense_slots_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 3)
    test_dense_slots_and_short_items(spark)


def test_one_question_with_other_numbers(spark):
    items = [(1, "A train travels 120 km in 3 hours. What is its speed?"), (2, "Who wrote Faust?")]
    texts = ["A train travels 90 km in 2 hours. What is its speed?", "so who wrote faust", "A train travels far. What is it?", prose(3, 80)]
    assert found(spark, texts, items) == {(0, 1), (1, 2)}


def test_screen_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SCREEN_WINDOWS", 4)
    test_dense_slots_and_short_items(spark)


def parsed(text):
    """(word in lower case, kind) of each word."""
    out, before = [], False
    for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
        number = any(c.isdigit() for c in w)
        kind = decontam.NUMBER if number else decontam.UNIT if before and w.lower() in decontam.UNITS else decontam.NAME if w[0].isupper() else decontam.LITERAL
        out.append((w.lower(), kind))
        before = number
    return out


def forms_of(item, width, need):
    """(first, end, exact, places) of an item's windows."""
    n, out, rest = len(item), [], []
    literals = lambda a, b: sum(k == decontam.LITERAL for _, k in item[a:b])
    for at in range(n - width + 1):
        right = next((b for b in range(at + width, n + 1) if literals(at, b) >= need), None)
        left = next((a for a in range(at, -1, -1) if literals(a, at + width) >= need), None)
        if right is not None:
            out.append((at, right, False, {at}))
        elif left is not None:
            out.append((left, at + width, False, {at}))
        else:
            rest.append(at)
        if literals(at, at + width) < width:
            out.append((at, at + width, True, {at}))
    if rest and literals(0, n):
        out.append((0, n, False, set(range(rest[0], rest[0] + len(rest)))))
    if 0 < n < width:
        out.append((0, n, True, {0}))
        if need <= literals(0, n) < n:
            out.append((0, n, False, {0}))
    return out


def brute(texts, items, width=5, coverage=0.5):
    got = set()
    for number, question in items:
        item = parsed(question)
        forms = forms_of(item, width, (width + 1) // 2)
        for d, text in enumerate(texts):
            doc, met, votes = parsed(text), [], defaultdict(Counter)
            for a, b, exact, places in forms:
                plain = exact or all(k == decontam.LITERAL for _, k in item[a:b])
                want = [w if plain else (w if k == decontam.LITERAL else None, k) for w, k in item[a:b]]
                for s in range(len(doc) - (b - a) + 1):
                    run = doc[s : s + b - a]
                    if [w if plain else (w if k == decontam.LITERAL else None, k) for w, k in run] == want:
                        pairs = [] if plain else [(x, y) for (x, k), (y, _) in zip(item[a:b], run) if k != decontam.LITERAL]
                        met.append((frozenset(places), pairs))
                        for x, y in pairs:
                            votes[x][y] += 1
            # ties between values are avoided by these texts
            chosen = {x: max(c, key=lambda y: (c[y], y == x)) for x, c in votes.items()}
            covered = set().union(*[p for p, pairs in met if all(chosen[x] == y for x, y in pairs)])
            total = max((max(p) + 1 for *_, p in forms), default=0)
            if total and len(covered) >= coverage * total:
                got.add((d, number))
    return got


def test_against_brute_force(spark):
    r = random.Random(12)
    names, units, plain = ["Anna", "Peter", "Maria", "Hugo"], ["km", "kg", "euros", "hours"], "buys sells in the of to and with for every house river road how many are left".split()

    def value(kind):
        return str(r.randint(2, 99)) if kind == "#" else r.choice(names) if kind == "@" else r.choice(units)

    shapes = [[r.choice(plain) if r.random() < 0.55 else r.choice("#@") for _ in range(r.randint(2, 24))] for _ in range(14)]
    fill = lambda shape: " ".join(value(x) if x in "#@" else x for x in shape)
    items = [(i, fill(shape)) for i, shape in enumerate(shapes)]
    texts = [f"{prose(i, 6)} {fill(shapes[i % 14])} {prose(i + 60, 5)}" for i in range(14)]
    texts += [f"{prose(i, 4)} {items[i][1].upper() if i % 2 else items[i][1]}" for i in range(14)]
    texts += [fill([r.choice(plain + ["#", "@"]) for _ in range(60)]) for _ in range(12)]
    want = brute(texts, items)
    assert found(spark, texts, items) == want and len(want) >= 14


def test_slots_must_agree(spark):
    item = "Tom pays 5 and Tom gets 9 while the shop keeps the rest of what Tom paid there for good"
    same = item.replace("Tom", "Ben")
    mixed = "Ben pays 5 and Jim gets 9 while the shop keeps the rest of what Sue paid there for good"
    rows = {r.doc_id: r.coverage for r in decontam.contaminated(frame(spark, [same, mixed]), bench(spark, [(1, item)]), coverage=0.01).collect()}
    assert rows[0] >= 0.8 and rows[1] <= rows[0] - 0.1


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    texts = [f"{prose(i, 20)} {ITEM if i % 3 == 0 else ''} {prose(i + 90, 9)}" for i in range(12)]
    small = found(spark, texts, [(1, ITEM), (2, prose(77, 25))])
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 3)
    assert found(spark, texts, [(1, ITEM), (2, prose(77, 25))]) == small == {(i, 1) for i in range(0, 12, 3)}


def test_rows_are_dropped_whole(spark):
    docs = frame(spark, [ITEM, prose(1, 50), None, ITEM, prose(2, 9)], ids=[1, 1, None, None, 5])
    left = decontam.decontaminate(docs, bench(spark, [(1, ITEM)]))
    assert left.schema == docs.schema
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted([("1", prose(1, 50)), ("None", ""), ("5", prose(2, 9))])
    assert decontam.report(decontam.contaminated(docs, bench(spark, [(1, ITEM)]))).count() == 2


def test_empty_tables(spark):
    docs = frame(spark, [ITEM])
    assert decontam.decontaminate(docs, bench(spark, [(1, "a")]).limit(0)).count() == 1
    assert decontam.decontaminate(docs.limit(0), bench(spark, [(1, ITEM)])).count() == 0
