"""Places of regular-expression matches, in JVM expressions only.

Spark tells what matches but not where, so a text is split at its matches and the
places are running sums of the lengths of pieces and matches, in code points.
Sums go in two steps of the square root of the count, so a text with very many
matches stays far from quadratic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _running(lens: Column, offs: Column, step: Column, i: Column) -> Column:
    whole = F.floor(i / step).cast("int")
    return F.element_at(offs, whole + 1) + _sum(F.slice(lens, whole * step + 1, i - whole * step))


def all_matches(text: Column, patterns: Sequence[tuple[str, Column | None]], around: tuple[int, int] = (0, 0)) -> Column:
    """For each (pattern, guard), array<struct<start,end,text,before,after>> of its leftmost non-overlapping matches.

    No pattern matches the empty text; a guard is a cheap condition without which
    there is no match.  before and after hold as many characters as `around` tells,
    but reach no further than the match after the neighbouring one.
    """
    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")
    lead, trail = around

    def place(found: Column, pieces: Column) -> Column:
        n = F.size(found)
        step = F.ceil(F.sqrt(n)).cast("int")
        lens = F.zip_with(F.slice(pieces, 1, n), found, lambda a, b: F.length(a) + F.length(b))

        def with_lens(lens: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1)
            sums = F.transform(blocks, lambda k: _sum(F.slice(lens, k * step + 1, step)))

            def with_offs(offs: Column) -> Column:
                def one(found_i: Column, i: Column) -> Column:
                    start = _running(lens, offs, step, i) + F.length(F.element_at(pieces, i + 1))
                    near = lambda xs, k: F.coalesce(F.get(xs, k), F.lit(""))
                    before = F.right(F.concat(F.right(near(pieces, i - 1), F.lit(lead)), near(found, i - 1), near(pieces, i)), F.lit(lead)) if lead else F.lit("")
                    after = F.left(F.concat(near(pieces, i + 1), near(found, i + 1), F.left(near(pieces, i + 2), F.lit(trail))), F.lit(trail)) if trail else F.lit("")
                    return F.struct(start.alias("start"), (start + F.length(found_i)).alias("end"), found_i.alias("text"), before.alias("before"), after.alias("after"))

                return F.transform(found, one)

            return let(sums, lambda sums: let(F.transform(blocks, lambda k: _sum(F.slice(sums, F.lit(1), k))), with_offs))

        return let(lens, with_lens)

    def raw(pattern: str, guard: Column | None) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if guard is not None:
            found = F.when(guard, found).otherwise(F.array().cast("array<string>"))
        return let(found, lambda found: F.struct(found.alias("found"), F.when(F.size(found) > 0, F.split(text, pattern, -1)).alias("pieces")))

    each = F.array(*[raw(pattern, guard) for pattern, guard in patterns])
    return F.transform(each, lambda m: F.when(F.size(m["found"]) > 0, place(m["found"], m["pieces"])).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of one pattern's leftmost non-overlapping matches."""
    return F.transform(F.element_at(all_matches(text, [(pattern, None)]), 1), lambda s: F.struct(s["start"], s["end"], s["text"]))


def _below(keys: Column, bound: Column) -> Column:
    """How many entries of an ascending array of numbers are under a bound, by halving."""
    n = F.size(keys)
    steps = F.sequence(F.length(F.bin(n.cast("long"))) - 1, F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        after = at + F.pow(F.lit(2.0), k).cast("int")
        return F.when((after <= n) & (F.element_at(keys, F.least(after, n)) < bound), after).otherwise(at)

    return F.when(n > 0, F.aggregate(steps, F.lit(0), step)).otherwise(F.lit(0))


def indexed(lists: Column) -> Column:
    """An array of lists of spans, each sorted and free of overlaps within itself, with starts and ends, for overlapping()."""
    return F.transform(lists, lambda s: F.struct(s.alias("spans"), F.transform(s, lambda x: x["start"]).alias("starts"), F.transform(s, lambda x: x["end"]).alias("ends")))


def overlapping(index: Column, span: Column) -> Column:
    """The spans of one list of indexed() that a span overlaps, found by halving."""
    cut = lambda ended: F.slice(index["spans"], ended + 1, F.greatest(_below(index["starts"], span["end"]) - ended, F.lit(0)))
    return let(_below(index["ends"], span["start"] + 1), cut)


def meets(indexes: Column, span: Column) -> Column:
    """Whether a span overlaps any span of any list."""
    return F.exists(indexes, lambda i: F.size(overlapping(i, span)) > 0)


def joined(spans: Column) -> Column:
    """kind:start:end of array<struct<start,rank,end,kind>>, in order, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def labelled(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
