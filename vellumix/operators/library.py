"""The library of results: search, facets, sorting, paging, and its maintenance as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vellumix.functions.text import trim_ws
from vellumix.session import ship

SORT_FIELDS = ("created_at", "updated_at", "title")
PATCHABLE = ("tags", "favorite", "title", "highlighted")
KEPT_ON_UPSERT = ("id", "created_at", "tags", "favorite", "highlighted")


def tags(values: Column) -> Column:
    """Trimmed, without empty ones, each once in its first place."""
    return F.array_distinct(F.filter(F.transform(values, trim_ws), lambda t: t != ""))


def source_dir(records: DataFrame) -> Column:
    return F.when(records["source_kind"] == "url", records["source_host"]).otherwise(records["source_dir"])


def matches_query(records: DataFrame, query: str) -> Column:
    """Whether title, name, source or a tag contains the query, case aside."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    hits = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle)) for c in ("title", "name", "source_value")]
    return hits[0] | hits[1] | hits[2] | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(needle)))


def matches_facets(records: DataFrame, facets: dict[str, object]) -> Column:
    """All given facets at once: source_type, target, month, source_dir, tag, favorite."""
    tests = {
        "source_type": lambda v: F.col("source_type") == v, "target": lambda v: F.col("target") == v,
        "month": lambda v: F.substring("created_at", 1, 7) == v, "source_dir": lambda v: source_dir(records) == v,
        "tag": lambda v: F.array_contains("tags", v), "favorite": lambda v: F.col("favorite") == F.lit(bool(v)),
    }
    if unknown := set(facets) - set(tests):
        raise ValueError(f"unknown facets: {sorted(unknown)}")
    out = F.lit(True)
    for name, value in facets.items():
        if value is not None and value != "":
            out = out & tests[name](value)
    return out


def search(records: DataFrame, query: str = "", facets: dict[str, object] | None = None) -> DataFrame:
    return records.where(matches_query(records, query) & matches_facets(records, facets or {}))


def facet_counts(records: DataFrame) -> DataFrame:
    """facet, value and count over records, in one pass: every facet is a key of the same aggregate."""
    pairs = [
        ("source_type", F.array("source_type")), ("target", F.array("target")), ("month", F.array(F.substring("created_at", 1, 7))),
        ("source_dir", F.array(source_dir(records))), ("tag", F.col("tags")), ("favorite", F.array(F.col("favorite").cast("string"))),
    ]
    each = F.concat(*[_named(name, values) for name, values in pairs])
    return records.select(F.explode(each).alias("f")).where("f.value is not null and f.value <> ''").groupBy(F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(F.count("*").alias("count"))


def _named(facet: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))


def page(records: DataFrame, sort: str = "created_at", descending: bool = True, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Sorted by a field and then id, both the same way, and cut to a page."""
    if sort not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {sort}")
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    key = F.collate(F.col(sort), "zh") if sort == "title" else F.col(sort)
    order = [c.desc() if descending else c.asc() for c in (key, F.col("id"))]
    out = records.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def upsert(records: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Records merged with results by output_path; existing ones keep their id, creation time, tags and marks."""
    old, new = records.alias("o"), results.alias("n")
    joined = old.join(new, F.col("o.output_path") == F.col("n.output_path"), "full")
    hit, was = F.col("n.output_path").isNotNull(), F.col("o.id").isNotNull()
    out = []
    for c in records.columns:
        if c == "updated_at":
            value = F.when(hit, F.lit(now)).otherwise(F.col("o.updated_at"))
        elif c == "created_at":
            value = F.when(was, F.col("o.created_at")).otherwise(F.lit(now))
        elif c in KEPT_ON_UPSERT:
            value = F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        else:
            value = F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(value.alias(c))
    return joined.select(*out)


def patch(records: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Records with the patchable fields of changes (by id) where those are not null; an empty title falls back to the name."""
    given = [c for c in changes.columns if c in PATCHABLE]
    right = changes.select(F.col("id").alias("__vx_id"), *[F.col(c).alias(f"__vx_{c}") for c in given])
    joined = records.join(right, records["id"] == right["__vx_id"], "left")
    out = []
    for c in records.columns:
        value = F.col(c)
        if c in given:
            new = F.col(f"__vx_{c}")
            new = tags(new) if c == "tags" else F.when(new.isNotNull(), F.coalesce(F.nullif(trim_ws(new), F.lit("")), F.col("name"))) if c == "title" else new
            value = F.coalesce(new, value)
        if c == "updated_at":
            value = F.when(F.col("__vx_id").isNotNull(), F.lit(now)).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def remove(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id").distinct(), "id", "left_anti").select(*records.columns)


def moved(value: Column, from_dir: str, to_dir: str) -> Column:
    """A path under from_dir moved to to_dir; others as they are."""
    inside = (value == from_dir) | value.startswith(f"{from_dir}/")
    return F.when(inside, F.concat(F.lit(to_dir), F.substring(value, len(from_dir) + 1, 1 << 20))).otherwise(value)


def relocate(records: DataFrame, from_dir: str, to_dir: str, now: str) -> DataFrame:
    """Records under from_dir point under to_dir, are managed and updated."""
    inside = (F.col("output_path") == from_dir) | F.col("output_path").startswith(f"{from_dir}/")
    return records.withColumns({"output_path": moved(F.col("output_path"), from_dir, to_dir), "managed": F.col("managed") | inside, "updated_at": F.when(inside, F.lit(now)).otherwise(F.col("updated_at"))})


def absent(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose output_path no existing path equals."""
    return records.join(existing.select("output_path").distinct(), "output_path", "left_anti").select(*records.columns)


def _next_free(want: str, taken: set[str], make) -> str:
    if want not in taken:
        return want
    n = 2
    while make(n) in taken:
        n += 1
    return make(n)


def registered_names(inputs: DataFrame, group: str = "slot") -> DataFrame:
    """ord, name and final_name: each input's unique output name, in input order.

    inputs: ord, name, source_ext (null for URLs), slot (what follows a name in its
    place: nothing for folders, .ext for single files).  Names that can never meet
    are apart: a group holds one slot and one first name with any suffix cut off.
    """
    ship(inputs.sparkSession)
    stem = F.regexp_replace("name", r"(?: \([^()]*\))+\z", "")
    keyed = inputs.select("ord", "name", "source_ext", "slot", stem.alias("stem"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, str | None] = {}
        finals = []
        rows = rows.sort_values("ord")
        for name, ext in zip(rows["name"], rows["source_ext"]):
            ext = ext if isinstance(ext, str) else None
            final = name
            if name in taken:
                tagged = f"{name} ({ext})" if ext and ext != taken[name] else None
                if tagged and tagged not in taken:
                    final = tagged
                else:
                    base = tagged or name
                    n = 2
                    while f"{base} ({n})" in taken:
                        n += 1
                    final = f"{base} ({n})"
            taken[final] = ext
            finals.append(final)
        return pd.DataFrame({"ord": rows["ord"], "name": rows["name"], "final_name": finals})

    return keyed.groupBy("slot", "stem").applyInPandas(settle, "ord long, name string, final_name string")


def migration_plan(records: DataFrame, root: str) -> DataFrame:
    """id, from_path, to_path, conflict and skip reason of moving records under root/YYYY-MM, first come first served."""
    ship(records.sparkSession)
    path = trim_ws(F.coalesce("output_path", F.lit("")))
    month = F.substring("created_at", 1, 7)
    reason = (
        F.when(path == "", "no output path").when(F.col("managed"), "already managed").when((path == root) | path.startswith(f"{root}/"), "already inside the root")
        .when(~F.coalesce(month.rlike(r"\A[0-9]{4}-[0-9]{2}\z"), F.lit(False)), "no month")
    )
    planned = records.select("ord", "id", path.alias("from_path"), F.concat(F.lit(f"{root}/"), month).alias("dir"), F.element_at(F.split(path, "/"), -1).alias("base"), reason.alias("reason"))
    skipped = planned.where("reason is not null").select("id", "from_path", F.lit(None).cast("string").alias("to_path"), F.lit(False).alias("conflict"), "reason")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for row in rows.sort_values("ord").itertuples():
            stem, dot, ext = row.base.rpartition(".")
            known = bool(stem) and 1 <= len(ext) <= 8 and ext.isalnum() and ext.isascii()
            stem, tail = (stem, dot + ext) if known else (row.base, "")
            to = _next_free(f"{row.dir}/{row.base}", taken, lambda n: f"{row.dir}/{stem} ({n}){tail}")  # noqa: B023
            taken.add(to)
            out.append((row.id, row.from_path, to, to != f"{row.dir}/{row.base}", None))
        return pd.DataFrame(out, columns=["id", "from_path", "to_path", "conflict", "reason"])

    stem = F.regexp_replace(F.regexp_replace("base", r"(?<=.)\.[A-Za-z0-9]{1,8}\z", ""), r"(?: \([0-9]+\))+\z", "")
    moves = planned.where("reason is null").withColumn("stem", stem).groupBy("dir", "stem").applyInPandas(settle, "id string, from_path string, to_path string, conflict boolean, reason string")
    return moves.union(skipped)


def record_paths(path: Column, outputs: Column, extras: Column) -> Column:
    """A record's path, its outputs and those extras that stay inside it, each once in its first place.

    Extras are relative; one that climbs out (..) or starts at the root is not the record's.
    """
    inside = F.filter(F.coalesce(extras, F.array().cast("array<string>")), lambda e: (e != "") & ~e.startswith("/") & ~e.rlike(r"(?:\A|/)\.\.(?:/|\z)"))
    own = F.transform(inside, lambda e: F.concat(F.regexp_replace(path, "/+\\z", ""), F.lit("/"), F.regexp_replace(e, r"\A(?:\./+)+", "")))
    return F.array_distinct(F.filter(F.concat(F.array(path), F.coalesce(outputs, F.array().cast("array<string>")), own), lambda p: p.isNotNull() & (p != "")))


def loaded(lines: DataFrame, schema: str, column: str = "value", version: int = 1) -> DataFrame:
    """Records of an index of JSON lines, with issue: null for a good one, else why it is passed over.

    Broken JSON, another version, and a record without id or output_path are issues; so is an id's second record.
    """
    parsed = F.from_json(F.col(column), f"version INT, {schema}, __vx_bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__vx_bad"})
    rows = lines.select("ord", parsed.alias("r")).select("ord", "r.*")
    blank = lambda c: F.coalesce(trim_ws(F.col(c)), F.lit("")) == ""
    why = F.when(F.col("__vx_bad").isNotNull(), "not JSON").when(~F.col("version").eqNullSafe(F.lit(version)), "version").when(blank("id"), "no id").when(blank("output_path"), "no output path")
    rows = rows.withColumn("issue", why)
    alone = F.concat(F.lit("#"), F.col("ord").cast("string"))  # rows with an issue are no group
    again = F.row_number().over(Window.partitionBy(F.col("issue").isNull(), F.when(F.col("issue").isNull(), F.col("id")).otherwise(alone)).orderBy("ord")) > 1
    return rows.withColumn("issue", F.when(F.col("issue").isNull() & again, "repeated id").otherwise(F.col("issue"))).drop("__vx_bad", "version")
