"""Readers of zipped office documents and positioned text, as Arrow functions over binary files.

Input is what spark.read.format("binaryFile") gives: path and content.  A broken
file is a row with an error, never a failed task; sizes and counts are bounded.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from vellumix.session import ship

MOST_ENTRIES, MOST_BYTES = 2000, 512 << 20
_A, _P = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_W, _S = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def opened(content: bytes) -> zipfile.ZipFile:
    """A zip whose names are safe and whose size is bounded."""
    z = zipfile.ZipFile(io.BytesIO(content))
    infos = z.infolist()
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
        raise ValueError("too many entries or bytes")
    for info in infos:
        name = info.filename.replace("\\", "/")
        if name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name.split("/") or "\0" in name:
            raise ValueError(f"unsafe name {name}")
    return z


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        body = z.read(name)
    except KeyError:
        return None
    if b"<!DOCTYPE" in body[:4096]:
        raise ValueError("document types are not read")
    return ET.fromstring(body)


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Id to (kind, resolved target) of a part's relations."""
    folder, _, base = part.rpartition("/")
    root = _part(z, f"{folder}/_rels/{base}.rels")
    out = {}
    for rel in root if root is not None else ():
        target = rel.get("Target", "")
        steps = [] if target.startswith("/") else folder.split("/")
        for step in target.lstrip("/").split("/"):
            steps = steps[:-1] if step == ".." else steps if step == "." else [*steps, step]
        out[rel.get("Id")] = (rel.get("Type", "").rpartition("/")[2], "/".join(s for s in steps if s))
    return out


_DATES = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])


def _cell(cell: ET.Element, shared: list[str], dates: set[int]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    value = cell.findtext(f"{_S}v")
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind in ("str", "e", "d"):
        return value
    number = float(value)
    if int(cell.get("s", "0")) in dates:
        return (datetime(1899, 12, 30) + timedelta(days=number)).strftime("%Y-%m-%d %H:%M:%S")
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


def sheet_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet, name, row, cells) of every row that isn't empty; rows of a sheet are padded to its widest."""
    z = opened(content)
    strings = _part(z, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in strings] if strings is not None else []
    styles, dates = _part(z, "xl/styles.xml"), set()
    if styles is not None:
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_S}numFmt") if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
        xfs = styles.find(f"{_S}cellXfs")
        dates = {i for i, xf in enumerate(xfs if xfs is not None else ()) if int(xf.get("numFmtId", "0")) in _DATES | own}
    rels = _relations(z, "xl/workbook.xml")
    for n, sheet in enumerate(_part(z, "xl/workbook.xml").iter(f"{_S}sheet")):
        root = _part(z, rels[sheet.get(f"{_R}id")][1])
        rows = []
        for row in root.iter(f"{_S}row"):
            cells: list[str] = []
            for cell in row.iter(f"{_S}c"):
                letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                at = at - 1 if letters else len(cells)
                cells += [""] * (at - len(cells))
                cells.append(_cell(cell, shared, dates))
            if any(cells):
                rows.append(cells)
        width = max((len(r) for r in rows), default=0)
        for i, cells in enumerate(rows):
            yield n, sheet.get("name", ""), i, cells + [""] * (width - len(cells))


def _paragraphs(body: ET.Element) -> list[str]:
    return ["".join((t.text or "") if t.tag == f"{_A}t" else "\n" for t in p.iter() if t.tag in (f"{_A}t", f"{_A}br")) for p in body.iter(f"{_A}p")]


def slides(content: bytes) -> Iterator[tuple[int, str, list[str], str, list[str]]]:
    """(number, title, bodies, notes, images) by slide number; without a title the first body is promoted."""
    z = opened(content)
    numbered = sorted((int(m[1]), m[0]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()) if m)
    for number, name in numbered:
        root, rels = _part(z, name), _relations(z, name)
        title, bodies = "", []
        for shape in root.iter(f"{_P}sp"):
            body = shape.find(f"{_P}txBody")
            text = "\n".join(x for x in (s.strip() for s in _paragraphs(body)) if x) if body is not None else ""
            place = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            if text and place is not None and place.get("type") in ("title", "ctrTitle") and not title:
                title = text
            elif text:
                bodies.append(text)
        if not title and bodies:
            title = bodies.pop(0)
        images = [rels[b.get(f"{_R}embed")][1] for b in root.iter(f"{_A}blip") if b.get(f"{_R}embed") in rels]
        notes = ""
        for kind, target in rels.values():
            page = _part(z, target) if kind == "notesSlide" else None
            for shape in page.iter(f"{_P}sp") if page is not None else ():
                place = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                if place is not None and place.get("type") == "body":
                    notes = "\n".join(s for s in _paragraphs(shape) if s.strip())
        yield number, title, bodies, notes, images


def _run_text(node: ET.Element) -> str:
    """Text of runs: tabs and breaks as characters, deleted text left out."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((t.text or "") if t.tag == f"{_W}t" else marks.get(t.tag, "") for r in ([node] if node.tag == f"{_W}r" else node.iter(f"{_W}r")) for t in r)


def word_blocks(content: bytes) -> Iterator[tuple[int, str, str, int | None, list[list[str]] | None]]:
    """(position, kind, text, level, rows) of a text document: headings, list items, paragraphs, tables, images."""
    z = opened(content)
    styles, levels = _part(z, "word/styles.xml"), {}
    for style in styles.iter(f"{_W}style") if styles is not None else ():
        name = style.find(f"{_W}name")
        m = re.fullmatch(r"(?i)heading ([1-9])", name.get(f"{_W}val", "") if name is not None else "")
        if m:
            levels[style.get(f"{_W}styleId")] = int(m[1])
    at = 0
    for node in _part(z, "word/document.xml").find(f"{_W}body"):
        if node.tag == f"{_W}tbl":
            rows = [["\n".join(_run_text(p) for p in tc.iter(f"{_W}p")) for tc in tr.findall(f"{_W}tc")] for tr in node.findall(f"{_W}tr")]
            yield at, "table", "", None, rows
            at += 1
        elif node.tag == f"{_W}p":
            props = node.find(f"{_W}pPr")
            style = props.find(f"{_W}pStyle") if props is not None else None
            level = levels.get(style.get(f"{_W}val")) if style is not None else None
            listed = props is not None and props.find(f"{_W}numPr") is not None
            text = "".join(_run_text(r) for r in node.iter(f"{_W}r")).strip()
            if text:
                yield at, "heading" if level else "list_item" if listed else "paragraph", text, level, None
                at += 1
            for blip in node.iter(f"{_A}blip"):
                yield at, "image", blip.get(f"{_R}embed", ""), None, None
                at += 1


def _exploded(files: DataFrame, read: Callable[[bytes], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, error = [], None
                try:
                    rows = list(read(content.as_py() or b""))
                except (ValueError, KeyError, IndexError, AttributeError, zipfile.BadZipFile, ET.ParseError) as broken:
                    error = f"{type(broken).__name__}: {broken}"
                rows = rows or ([(None,) * (len(schema) - 2)] if error else [])
                columns = list(zip(*[(path, *r, error) for r in rows])) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("path", pa.string()), *fields, ("error", pa.string())])


_STRINGS = pa.list_(pa.string())


def read_sheets(files: DataFrame) -> DataFrame:
    schema = _schema(("sheet_idx", pa.int32()), ("sheet", pa.string()), ("row_idx", pa.int32()), ("cells", _STRINGS))
    return _exploded(files, sheet_rows, schema, "path string, sheet_idx int, sheet string, row_idx int, cells array<string>, error string")


def read_slides(files: DataFrame) -> DataFrame:
    schema = _schema(("slide_num", pa.int32()), ("title", pa.string()), ("bodies", _STRINGS), ("notes", pa.string()), ("images", _STRINGS))
    return _exploded(files, slides, schema, "path string, slide_num int, title string, bodies array<string>, notes string, images array<string>, error string")


def read_word(files: DataFrame) -> DataFrame:
    schema = _schema(("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("rows", pa.list_(_STRINGS)))
    return _exploded(files, word_blocks, schema, "path string, pos int, kind string, text string, level int, rows array<array<string>>, error string")
