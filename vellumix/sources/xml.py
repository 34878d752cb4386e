"""XML as tables: a scanner that reports errors as values, node rows, and sniffing of the root."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vellumix.functions.text import text_of
from vellumix.session import ship

MOST_DEPTH, MOST_BYTES = 64, 32 << 20


def root_name(text: Column | str) -> Column:
    """The first element's name after a byte-order mark, white space, instructions, comments and a document type."""
    prolog = r"(?s)\A\x{FEFF}?(?:\s+|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>)*+<([A-Za-z_:][^\s/>]*)"
    return F.nullif(F.regexp_extract(text_of(text), prolog, 1), F.lit(""))


def nodes(text: str) -> list[tuple[int, int | None, int, int, str, str | None, list[tuple[str, str]]]]:
    """(node, parent, ordinal, depth, name, value, attributes) in preorder; text nodes are named #text.

    Raises ValueError for what isn't well formed, too deep, too long, or declares entities.
    """
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("too long")
    rows: list = []
    stack: list[int] = []
    counts: dict[int | None, int] = {}
    parts: list[str] = []

    def add(name: str, value: str | None, attrs: list[tuple[str, str]]) -> int:
        up = stack[-1] if stack else None
        counts[up] = counts.get(up, -1) + 1
        rows.append((len(rows), up, counts[up], len(stack), name, value, attrs))
        return len(rows) - 1

    def flush() -> None:
        if parts and stack:
            add("#text", "".join(parts), [])
        parts.clear()

    def start(name: str, attrs: dict[str, str]) -> None:
        flush()
        if len(stack) >= MOST_DEPTH:
            raise ValueError("too deep")
        stack.append(add(name, None, list(attrs.items())))

    def end(_: str) -> None:
        flush()
        stack.pop()

    def entity(*_: object) -> None:
        raise ValueError("entities are not declared here")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, parts.append, entity
    try:
        parser.Parse(text.removeprefix("﻿"), True)
    except expat.ExpatError as broken:
        raise ValueError(str(broken)) from None
    return rows


def scan(texts: DataFrame, key: str = "doc_id", column: str = "xml") -> DataFrame:
    """key, node_id, parent_id, ord, depth, name, value, attrs and error; a broken text is one row with its error."""
    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    fields = pa.schema([("node_id", pa.int32()), ("parent_id", pa.int32()), ("ord", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("value", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                try:
                    found = [(*r, None) for r in nodes(text or "")]
                except ValueError as broken:
                    found = [(None,) * 6 + ([], str(broken))]
                rows += found
                owners += [i] * len(found)
            columns = list(zip(*rows)) or [()] * len(fields)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owners, pa.int64())), *arrays], names=[key, *fields.names])

    return texts.select(key, column).mapInArrow(run, f"{key} {kind}, node_id int, parent_id int, ord int, depth int, name string, value string, attrs map<string,string>, error string")
