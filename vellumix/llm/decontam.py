"""Benchmark decontamination by template windows with checked slots.

Numbers, names (capitalised words) and units after numbers become typed
placeholders, so an item asked again with other values keeps its template.  Every
run of `width` words of an item and of a document is hashed and hash-joined, by
its template and by its exact words in lower case; either may meet, so a copy in
other letter case is met too.  A template window with too few literal words is
widened to the right, or else to the left, until it has enough; where a whole item
has too few, it is one window of its own length, met by its template if it has any
literal word.  For each document and item that meet, the item's slot values must
map to the document's consistently; windows against the majority don't count.  A
document whose windows cover `coverage` of an item's windows is contaminated.

The hashes of the benchmark's windows, 8 bytes each, screen the documents' windows
as those are made, SCREEN_WINDOWS at a time: a larger benchmark costs a further
pass over the documents for each such part.  So only windows that meet are joined:
with a broadcast of the benchmark's windows if there are BROADCAST_WINDOWS at most
(counted first), else by shuffle.  Equal windows of a document are sent once, with
their number.

Documents are also read at the widths of those items that are one window, a pass
for each such width.

Nulls and ties: a null text has no window; an item of fewer words than `width` is
one window, met by its exact words, or by its template if that has enough literals.  Items without id count by their text's hash.  Repeated rows
get equal results.  Of equally covered items the one with the smaller id is named.
Columns besides doc_id and text (item_id and text) are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vellumix.llm.scratch import Scratch, bounded
from vellumix.llm.tokens import NOT_ALNUM, doc_groups, hash_words, inside, prefix_sums, released, run_hashes, stream64, text_buffers, word_spans
from vellumix.session import ship

WIDTH, COVERAGE = 5, 0.5
BROADCAST_WINDOWS, SCREEN_WINDOWS = 1_000_000, 8_000_000
LITERAL, NUMBER, UNIT, NAME = range(4)
#: Words that measure when they follow a number.
UNITS = "mm cm m km in ft mile miles yard yards inch inches foot feet meter meters metre metres g kg mg lb lbs ounce ounces gram grams ton tons liter liters litre litres ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees mph kph hz khz mhz ghz kb mb gb tb w kw v a j kj cal".split()
_PLACES = stream64(4, 31)


def hash_unit(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(data)]), True)[0])


_UNIT_HASHES = np.array(sorted({hash_unit(u) for u in UNITS}), np.uint64)


def folded(column: pa.Array) -> pa.Array:
    """Texts without letter case; each keeps its number of words."""
    try:
        return pc.replace_substring(pc.utf8_lower(column), "ß", "ss")
    except pa.ArrowInvalid:  # bytes that are no text
        lower = lambda b: b.decode("utf-8", "surrogateescape").lower().replace("ß", "ss").encode("utf-8", "surrogateescape")
        return pa.array([None if b is None else lower(b) for b in column.cast(pa.binary()).to_pylist()], pa.binary())


def kinds_of(part: np.ndarray, bounds: np.ndarray, plain: np.ndarray, plain_bounds: np.ndarray):
    """Hashes of the words of a group of folded texts, their kinds from the texts as they are, and each text's first word."""
    starts, ends, first = word_spans(plain, plain_bounds, NOT_ALNUM)
    words = hash_words(plain, starts, ends, True)
    starts, ends, _ = word_spans(part, bounds, NOT_ALNUM)
    kinds = np.zeros(len(words), np.uint8)
    if len(words):
        digits = np.concatenate([[0], np.cumsum((part >= 0x30) & (part <= 0x39))])
        number = digits[ends] > digits[starts]
        lead = part[starts]
        second = part[np.minimum(starts + 1, len(part) - 1)]
        kinds[((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))] = NAME
        after = np.zeros(len(words), bool)
        after[1:] = number[:-1]
        after[first[:-1][first[:-1] < len(words)]] = False
        kinds[after & np.isin(words, _UNIT_HASHES)] = UNIT
        kinds[number] = NUMBER
    return words, kinds, first


class _Runs:
    """Windows of one group of texts, as first and end words, and their hashes."""

    def __init__(self, words: np.ndarray, kinds: np.ndarray, first: np.ndarray, width: int):
        self.kinds, self.first, self.width, self.need = kinds, first, width, (width + 1) // 2
        self.owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
        self.at = np.flatnonzero(kinds == LITERAL)
        self.sums = prefix_sums(words), prefix_sums(np.where(kinds == LITERAL, words, _PLACES[kinds]))

    def plain(self, width: int) -> np.ndarray:
        """First words of the runs of `width` words within one text."""
        return np.flatnonzero(inside(self.first, width))

    def literals(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.literal[ends] - self.literal[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, exact: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        for some, sums in zip((exact, ~exact), self.sums):
            out[some] = run_hashes(sums, starts[some], ends[some])
        return out

    def distinct(self, starts: np.ndarray, ends: np.ndarray, exact: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each text's windows that are equal in every word, and how many there are."""
        owner, plain = self.owner[starts], run_hashes(self.sums[0], starts, ends)
        order = np.lexsort((plain, hashes, exact, owner))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (owner, exact, hashes, plain)], axis=0)
        first = np.flatnonzero(new)
        return order[first], np.diff(np.append(first, len(order)))

    def rightwards(self, starts: np.ndarray) -> np.ndarray:
        """Where windows from these words hold enough literals; -1 where the text ends before."""
        last = np.append(self.at, np.full(self.need, len(self.kinds)))[self.literal[starts] + self.need - 1]
        ends = np.maximum(starts + self.width, last + 1)
        return np.where(ends <= self.first[self.owner[starts] + 1], ends, -1)

    def leftwards(self, ends: np.ndarray) -> np.ndarray:
        """The first words of windows up to these ends that hold enough literals; -1 where the text begins after."""
        k = self.literal[ends] - self.need
        starts = np.minimum(ends - self.width, np.append(self.at, -1)[np.maximum(k, -1)])
        return np.where((k >= 0) & (starts >= self.first[self.owner[ends - 1]]), starts, -1)


def _of_items(runs: _Runs):
    """Windows of items: starts, ends, exact, the place each stands for, how many places from there on, and whether of a width of its own."""
    found = []

    def put(starts, ends, exact, places, span, own):
        n = len(starts)
        found.append((starts, ends, np.full(n, exact), places, np.broadcast_to(span, n), np.full(n, own)))

    at = runs.plain(runs.width)
    right = runs.rightwards(at)
    put(at[right >= 0], right[right >= 0], False, at[right >= 0], 1, False)
    rest = at[right < 0]
    left = runs.leftwards(rest + runs.width)
    put(left[left >= 0], rest[left >= 0] + runs.width, False, rest[left >= 0], 1, False)
    owners, places, span = np.unique(runs.owner[rest[left < 0]], return_index=True, return_counts=True)
    places = rest[left < 0][places]
    lo, hi = runs.first[owners], runs.first[owners + 1]
    some = runs.literals(lo, hi) > 0
    put(lo[some], hi[some], False, places[some], span[some], True)
    slotted = at[runs.literals(at, at + runs.width) < runs.width]
    put(slotted, slotted + runs.width, True, slotted, 1, False)
    length = np.diff(runs.first)
    short = np.flatnonzero((length > 0) & (length < runs.width))
    lo, hi = runs.first[short], runs.first[short + 1]
    put(lo, hi, True, lo, 1, True)
    some = (runs.literals(lo, hi) >= runs.need) & (runs.literals(lo, hi) < hi - lo)
    put(lo[some], hi[some], False, lo[some], 1, True)
    return [np.concatenate(x) for x in zip(*found)]


def _of_documents(runs: _Runs, own: list[int], longest: int):
    """Every window of documents that an item can have: starts, ends, exact."""
    found = []

    def put(starts, ends, exact):
        fits = ends - starts <= longest
        found.append((starts[fits], ends[fits], np.full(int(fits.sum()), exact)))

    at = runs.plain(runs.width)
    right = runs.rightwards(at)
    put(at[right >= 0], right[right >= 0], False)
    few = at[runs.literals(at, at + runs.width) < runs.need]
    left = runs.leftwards(few + runs.width)
    put(left[left >= 0], few[left >= 0] + runs.width, False)
    slotted = at[runs.literals(at, at + runs.width) < runs.width]
    put(slotted, slotted + runs.width, True)
    for width in own:
        at = runs.plain(width)
        n = runs.literals(at, at + width)
        some = at[(n > 0) & (n < width) & ((n >= runs.need) | (width >= runs.width))]
        put(some, some + width, False)
        if width < runs.width:
            put(at, at + width, True)
    return [np.concatenate(x) for x in zip(*found)]


#: Words of windows in one batch of rows, and texts that a task holds at once.
_BATCH_WORDS, BATCH_ROWS = 200_000, 512


def _windows(width: int, key: list[str], known: np.ndarray | None = None, own: list[int] | None = None, longest: int = 0):
    """Rows (key..., hash, place, literals, kinds) of windows; of documents if `own` widths are given, then only those in `known`, with how many are equal; of items with span and own besides.

    Words of exact windows count as literals.
    """
    screen = None
    if known is not None:
        screen = np.zeros(1 << 20, bool)
        screen[(known & np.uint64(0xFFFFF)).astype(np.intp)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            plain, at_plain = text_buffers(folded(batch.column("text")))
            for lo, hi in doc_groups(offsets):
                words, kinds, first = kinds_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], plain[at_plain[lo] : at_plain[hi]], at_plain[lo : hi + 1] - at_plain[lo])
                runs = _Runs(words, kinds, first, width)
                starts, ends, exact, *more = _of_items(runs) if own is None else _of_documents(runs, own, longest)
                hashes = runs.hashes(starts, ends, exact)
                if known is not None:
                    at = np.flatnonzero(screen[(hashes & np.uint64(0xFFFFF)).astype(np.intp)])
                    at = at[np.isin(hashes[at], known)]
                    starts, ends, exact, hashes = starts[at], ends[at], exact[at], hashes[at]
                if own is not None:  # windows widened both ways or of an item's width can be the same
                    _, at = np.unique((starts * (longest + 1) + ends - starts) * 2 + exact, return_index=True)
                    starts, ends, exact, hashes = starts[at], ends[at], exact[at], hashes[at]
                    at, times = runs.distinct(starts, ends, exact, hashes)
                    starts, ends, exact, hashes = starts[at], ends[at], exact[at], hashes[at]
                total = np.concatenate([[0], np.cumsum(ends - starts)])
                i = 0
                while i < len(starts):
                    j = max(i + 1, int(np.searchsorted(total, total[i] + _BATCH_WORDS, "right")) - 1)
                    some = slice(i, j)
                    cuts = (total[i : j + 1] - total[i]).astype(np.int32)
                    spread = np.repeat(starts[some] - cuts[:-1], np.diff(cuts)) + np.arange(cuts[-1])
                    literals = pa.ListArray.from_arrays(cuts, words[spread].view(np.int64))
                    forms = np.where(np.repeat(exact[some], np.diff(cuts)), np.uint8(LITERAL), kinds[spread]).tobytes()
                    forms = pa.array([forms[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())
                    owner = runs.owner[starts[some]]
                    keys = [batch.column(c).take(pa.array(owner + lo)) for c in key]
                    places = (more[0] if more else starts)[some] - first[owner]
                    columns = [*keys, pa.array(hashes[some].view(np.int64)), pa.array(places.astype(np.int32)), literals, forms]
                    names = [*key, "hash", "place", "literals", "kinds"]
                    if more:
                        columns += [pa.array(more[1][some].astype(np.int32)), pa.array(more[2][some])]
                        names += ["span", "own"]
                    else:
                        columns.append(pa.array(times[some].astype(np.int32)))
                        names.append("times")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    i = j

    return released(run)


def _judge(coverage: float):
    """One document and one item: distinct windows of the item whose slots agree with the majority."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["item_place", "item_span", "item_literals", "item_kinds", "literals", "times"]).to_pylist()
        votes: dict[int, Counter] = defaultdict(Counter)
        slots = []
        for row in rows:
            pairs = [(a, b) for a, b, k in zip(row["item_literals"], row["literals"], row["item_kinds"]) if k != LITERAL]
            slots.append(pairs)
            for a, b in pairs:
                votes[a][b] += row["times"]
        chosen = {a: max(c, key=lambda b: (c[b], b == a, b)) for a, c in votes.items()}
        agreed = {(row["item_place"], row["item_span"]) for row, pairs in zip(rows, slots) if all(chosen[a] == b for a, b in pairs)}
        covered = {place for at, span in agreed for place in range(at, at + span)}
        share = len(covered) / table.column("n_windows")[0].as_py()
        out = table.select(["doc_id", "text_hash", "item"]).slice(0, 1 if share >= coverage else 0)
        return out.append_column("coverage", pa.array([share] * len(out), pa.float64()))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash, item, coverage for each document and item it gives away."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "decontam")
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text")).alias("item"), "text")
    shape = "hash long, place int, literals array<long>, kinds binary"
    parts = items.mapInArrow(_windows(width, ["item"]), f"item long, {shape}, span int, own boolean").distinct()
    named = {"place": "item_place", "literals": "item_literals", "kinds": "item_kinds", "span": "item_span"}
    parts = scratch.put(parts.withColumnsRenamed(named), "items", BATCH_ROWS)
    lengths = parts.agg(F.max(F.size("item_literals")).alias("longest"), F.sort_array(F.collect_set(F.when(F.col("own"), F.size("item_literals")))).alias("own")).first()
    sizes = parts.groupBy("item").agg(F.max(F.col("item_place") + F.col("item_span")).alias("n_windows"))
    parts = scratch.put(parts.join(sizes, "item"), "sized")
    small = bounded(parts, BROADCAST_WINDOWS)
    hashes = scratch.put(parts.select("hash").distinct(), "hashes")
    rounds = max(1, -(-hashes.count() // SCREEN_WINDOWS))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    met = None
    for i in range(rounds):
        some = hashes.where(F.pmod("hash", F.lit(rounds)) == i).orderBy("hash").toArrow().column("hash")
        known = np.concatenate([np.zeros(0, np.int64), *[c.to_numpy() for c in some.chunks]]).view(np.uint64)
        found = keyed.mapInArrow(_windows(width, ["doc_id", "text_hash"], np.sort(known), lengths.own, lengths.longest or 0), f"doc_id {kind}, text_hash long, {shape}, times int")
        found = found.join(F.broadcast(parts) if small else parts, "hash").select("doc_id", "text_hash", "item", "n_windows", "item_place", "item_span", "item_literals", "item_kinds", "literals", "times")
        if rounds > 1:
            found = scratch.put(found, "met", BATCH_ROWS)
        met = found if met is None else met.union(found)
    judged = met.groupBy("doc_id", "text_hash", "item").applyInArrow(_judge(coverage), f"doc_id {kind}, text_hash long, item long, coverage double")
    return scratch.put(judged, "judged", BATCH_ROWS)


def report(found: DataFrame) -> DataFrame:
    """A row for each contaminated document: doc_id, its worst item, that item's coverage, and how many items it gives away."""
    worst = F.max_by("item", F.struct("coverage", -F.col("item")))
    return found.groupBy("doc_id", "text_hash").agg(worst.alias("item_id"), F.max("coverage").alias("coverage"), F.count("*").alias("n_items")).drop("text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """Rows of docs, unchanged, that give no item away."""
    found = contaminated(docs, benchmark, width, coverage).select(F.col("doc_id").alias("__vx_doc"), F.col("text_hash").alias("__vx_hash")).distinct()
    if bounded(found, BROADCAST_WINDOWS):
        found = F.broadcast(found)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__vx_doc"]) & (F.xxhash64(docs["text"]) == found["__vx_hash"]), "left_anti")
