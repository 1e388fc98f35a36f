"""Archives and spreadsheets: zip members, XLSX and ODS sheets as rows, bodies of unknown kind.

Two ways in.  ``register(spark)`` adds the format ``workbook``: ``spark.read.format("workbook").load(path)`` lists files, splits
large archives by member, and streams rows; options ``title`` (a pattern that the printed title of a sheet must match) or ``sheet`` (its name).
For stores that only Spark can read, ``sheet_rows`` takes a table of (path, content), as the ``binaryFile`` source gives it.

A row is (file, member, sheet, title, row, cells, error), ``cells`` by column letter without empty ones.  Sheets are found by what is printed in
their first rows, since names and numbers change between editions.  Sheet XML is parsed as it is inflated and dropped row by row; what stays
in memory is one row and, for XLSX, the workbook's shared strings.

Edge cases: an archive inside an archive is read too; a damaged file or member gives one row with ``error``, after the rows before the damage;
a null or empty body is an error row; members that are no workbook give no row; repeated columns of an ODS cell count up to
``MOST_COLUMNS``, a repeat of more is filler and counts once, and so do more than ``MOST_REPEATS`` repeated rows.
"""

from __future__ import annotations

import gzip
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .posts_csv import decode

SCHEMA = "file string, member string, sheet string, title string, row int, cells map<string,string>, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

# The formats' caps, and how much of a sheet may print its title.
MOST_COLUMNS, MOST_REPEATS = 40, 20
TITLE_ROWS, TITLE_COLUMNS = 6, 12

_DAMAGE = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, EOFError, OSError, NotImplementedError, RuntimeError)


def letters(index: int) -> str:
    """Column letters of a place counted from 1."""
    out = ""
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _text(e: ElementTree.Element, but: str = "") -> str:
    """All text below an element, without what stands inside elements of the name ``but``."""
    parts = [e.text or ""]
    for child in e:
        if _local(child.tag) != but:
            parts.append(_text(child, but))
        parts.append(child.tail or "")
    return "".join(parts)


def _elements(stream, *names: str) -> Iterator[ElementTree.Element]:
    """Finished elements of these names; each is emptied after use, so a sheet never stands in memory."""
    parser = ElementTree.iterparse(stream, events=("start", "end"))
    above: list[ElementTree.Element] = []
    for event, e in parser:
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if _local(e.tag) in names:
            yield e
            e.clear()
            if above:
                above[-1].remove(e)


def _xlsx_sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) in the workbook's order."""
    with book.open("xl/_rels/workbook.xml.rels") as f:
        target = {e.get("Id"): e.get("Target", "") for e in ElementTree.parse(f).getroot()}
    with book.open("xl/workbook.xml") as f:
        sheets = [e for e in ElementTree.parse(f).iter() if _local(e.tag) == "sheet"]
    return [(e.get("name", ""), "xl/" + re.sub("^/?(xl/)?", "", target[_attribute(e, "id")])) for e in sheets]


def _xlsx_rows(book: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[dict[str, str]]:
    with book.open(member) as f:
        for row in _elements(f, "row"):
            out = {}
            for c in row:
                at = re.match("[A-Z]+", c.get("r") or "")
                if not at:
                    continue
                kind, value = c.get("t") or "n", next((_text(v) for v in c if _local(v.tag) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(_text(v, "rPh") for v in c if _local(v.tag) == "is")
                elif kind == "s" and value is not None:
                    value = shared[int(value)] if int(value) < len(shared) else None
                if value:
                    out[at[0]] = value
            yield out


def _ods_rows(book: zipfile.ZipFile) -> Iterator[tuple[str, dict[str, str] | None]]:
    """(sheet, row) over all sheets; a sheet begins with (name, None)."""
    with book.open("content.xml") as f:
        sheet, depth = "", 0
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            name = _local(e.tag)
            if event == "start" and name == "table":
                depth += 1
                if depth == 1:
                    sheet = _attribute(e, "name") or ""
                    yield sheet, None
            elif event == "end" and name == "table":
                depth -= 1
                e.clear()
            elif event == "end" and name == "table-row" and depth == 1:
                row, at = {}, 0
                for c in e:
                    if _local(c.tag) not in ("table-cell", "covered-table-cell") or at >= MOST_COLUMNS:
                        continue
                    value = _attribute(c, "value")
                    if value is None:
                        value = " ".join(_text(p) for p in c if _local(p.tag) == "p").strip() or None
                    times = int(_attribute(c, "number-columns-repeated") or 1)
                    for _ in range(1 if times > MOST_COLUMNS else times):
                        at += 1
                        if value is not None and at <= MOST_COLUMNS:
                            row[letters(at)] = value
                times = int(_attribute(e, "number-rows-repeated") or 1)
                for _ in range(1 if times > MOST_REPEATS else times):
                    yield sheet, dict(row)
                e.clear()


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[dict[str, str]]]]:
    """(sheet, its rows) of a workbook."""
    names = set(book.namelist())
    if "xl/workbook.xml" in names:
        shared = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as f:
                shared = [_text(e, "rPh") for e in _elements(f, "si")]
        for name, member in _xlsx_sheets(book):
            yield name, _xlsx_rows(book, member, shared)
    elif "content.xml" in names:
        rows = _ods_rows(book)
        ahead = next(rows, None)
        while ahead is not None:
            sheet = ahead[0]

            def own() -> Iterator[dict[str, str]]:
                nonlocal ahead
                for ahead in rows:
                    if ahead[1] is None:
                        return
                    yield ahead[1]
                ahead = None

            mine = own()
            yield sheet, mine
            for _ in mine:  # a sheet that nobody wants is passed over
                pass


def rows_of(file: str, member: str | None, body, *, title: str | None = None, sheet: str | None = None, only: frozenset[str] | None = None) -> Iterator[tuple]:
    """Rows of all workbooks in an archive (bytes or a seekable file); ``only``: members to look at."""

    def row(m, s=None, t=None, n=None, cells=None, error=None) -> tuple:
        return file, m, s, t, n, cells, error

    wanted = re.compile(title, re.IGNORECASE) if title else None
    try:
        if not body:
            raise ValueError("empty body")
        with zipfile.ZipFile(io.BytesIO(body) if isinstance(body, bytes) else body) as book:
            names = set(book.namelist())
            if names & {"xl/workbook.xml", "content.xml"}:
                for name, cells in _sheets(book):
                    if sheet is not None and name != sheet:
                        continue
                    head, printed = [], None
                    for r in cells:
                        head.append(r)
                        if wanted and printed is None:
                            near = {letters(k) for k in range(1, TITLE_COLUMNS + 1)}
                            printed = next((v.strip() for c, v in r.items() if c in near and wanted.search(v)), None)
                        if len(head) == TITLE_ROWS:
                            break
                    if wanted and printed is None:
                        continue
                    for n, r in enumerate((*head, *()), 1):
                        yield row(member, name, printed, n, r)
                    for n, r in enumerate(cells, len(head) + 1):
                        yield row(member, name, printed, n, r)
                    if wanted:
                        return  # the first sheet with the title
                return
            for info in book.infolist():
                if info.is_dir() or (only is not None and info.filename not in only):
                    continue
                inner = info.filename if member is None else f"{member}!{info.filename}"
                try:
                    with book.open(info) as f:
                        first = f.read(4)
                        if first == b"PK\x03\x04":
                            yield from rows_of(file, inner, first + f.read(), title=title, sheet=sheet)
                except _DAMAGE as why:
                    yield row(inner, error=f"{type(why).__name__}: {why}")
    except _DAMAGE as why:
        yield row(member, error=f"{type(why).__name__}: {why}")


def _batches(rows: Iterator[tuple], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.map_(pa.string(), pa.string()) if n == "cells" else pa.int32() if n == "row" else pa.string()) for n in NAMES])
    held = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*held))
        columns[5] = [None if c is None else list(c.items()) for c in columns[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) == most:
            yield made()
            held = []
    if held:
        yield made()


def sheet_rows(files: DataFrame, *, title: str | None = None, sheet: str | None = None) -> DataFrame:
    """Rows of the workbooks in a table of (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                yield from _batches(rows_of(path, None, content.as_py(), title=title, sheet=sheet))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, frozenset[str] | None]]):
        self.files = files


class _Reader(DataSourceReader):
    """Small files share a partition; an archive above ``splitBytes`` is split by its members."""

    def __init__(self, options: dict[str, str]):
        self.path, self.title, self.sheet = options["path"], options.get("title"), options.get("sheet")
        self.split = int(options.get("splitbytes", 8 << 20))

    @staticmethod
    def _open(path: str):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(path)
        return files, at

    def _listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        files, at = self._open(self.path if "://" in self.path else f"file://{self.path}")
        info = files.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else "file://"
        named = lambda p: p if "://" in p else scheme + p
        return sorted((named(f.path), f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def partitions(self) -> list[InputPartition]:
        parts, small, size = [], [], 0
        for path, n in self._listed():
            if n <= self.split:
                small.append((path, None))
                size += n
                if size > self.split:
                    parts.append(_Part(small))
                    small, size = [], 0
                continue
            try:
                files, at = self._open(path)
                with files.open_input_file(at) as f, zipfile.ZipFile(f) as book:
                    members = [i.filename for i in book.infolist() if not i.is_dir()]
                split = [] if {"xl/workbook.xml", "content.xml"} & set(members) else members
            except _DAMAGE:
                split = []
            parts += [_Part([(path, frozenset([m]))]) for m in split] or [_Part([(path, None)])]
        return parts + ([_Part(small)] if small else [])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, only in partition.files if partition else []:
            files, at = self._open(path)
            with files.open_input_file(at) as f:
                yield from _batches(rows_of(path, None, f if f.size() else b"", title=self.title, sheet=self.sheet, only=only))


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("workbook")`` known to the session."""
    spark.dataSource.register(Workbooks)


BODY = "path string, ok boolean, reason string, detail string, text string"


def bodies(files: DataFrame) -> DataFrame:
    """(path, ok, reason, detail, text) of a table of (path, content): gzip is opened, binary files and web pages are refused.

    A body is judged by its bytes, not by its name; null is an empty text.
    """
    magic = ((b"%PDF", "pdf"), (b"PK\x03\x04", "zip/xlsx"), (b"\xd0\xcf\x11\xe0", "xls"), (b"\x1f\x8b", "gzip"))
    page = re.compile(r"<!doctype html|<html[\s>]|<head[\s>]")
    kind_of = lambda b: next((n for m, n in magic if b.startswith(m)), None) if len(b) >= 4 else None

    def judged(body: bytes) -> tuple:
        kind = kind_of(body)
        if kind == "gzip":
            try:
                body = gzip.decompress(body)
            except _DAMAGE:
                return False, "archived-body-is-binary", "gzip", None
            kind = kind_of(body)
        if kind:
            return False, "archived-body-is-binary", kind, None
        text = decode(body)
        if page.search(text[:1024].lower()):
            return False, "archived-body-is-html", None, None
        return True, None, None, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                out = (path, *judged(content.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.bool_() if i == 1 else pa.string()) for i, x in enumerate(out)], names=[c.split()[0] for c in BODY.split(", ")])

    return files.select("path", "content").mapInArrow(run, BODY)
