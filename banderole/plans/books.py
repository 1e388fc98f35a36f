"""Spreadsheets, archives and bodies made from the customers table and read back."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import workbooks
from .stand_in import query, table

TITLE = "Table 36: Balances by customer"
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_ODS = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'


def _zip(members: dict[str, str | bytes], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), body, compress_type=method)
    return out.getvalue()


def xlsx(sheets: dict[str, list[list[str | float | None]]]) -> bytes:
    """A small workbook: shared strings, numbers, and inline strings in the last column."""
    shared: dict[str, int] = {}

    def cell(v, r: int, c: int, last: bool) -> str:
        at = f"{workbooks.letters(c)}{r}"
        if v is None:
            return ""
        if not isinstance(v, str):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        if last:
            return f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f'<c r="{at}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'

    body = {
        f"xl/worksheets/sheet{k}.xml": f"<worksheet {_NS}><sheetData>" + "".join(f'<row r="{r}">' + "".join(cell(v, r, c, c == len(row)) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>"
        for k, rows in enumerate(sheets.values(), 1)
    }
    strings = f"<sst {_NS}>" + "".join(f"<si><t>{escape(s)}</t><rPh><t>x</t></rPh></si>" for s in shared) + "</sst>"
    book = f"<workbook {_NS}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>"
    rels = "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>"
    return _zip({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": strings, **body})


def ods(sheets: dict[str, list[list[str | float | None]]]) -> bytes:
    """A small document: repeated empty cells and filler rows as office programs write them."""

    def cell(v) -> str:
        if v is None:
            return "<table:table-cell/>"
        if not isinstance(v, str):
            return f'<table:table-cell office:value-type="float" office:value="{v!r}"><text:p>shown</text:p></table:table-cell>'
        return f"<table:table-cell><text:p>{escape(v)}</text:p></table:table-cell>"

    def sheet(name: str, rows: list) -> str:
        filler = '<table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
        return f'<table:table table:name="{escape(name)}">' + "".join("<table:table-row>" + "".join(map(cell, r)) + '<table:table-cell table:number-columns-repeated="16000"/></table:table-row>' for r in rows) + filler + "</table:table>"

    return _zip({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f"<office:document {_ODS}>" + "".join(sheet(n, r) for n, r in sheets.items()) + "</office:document>"})


def books_of(spark, sf) -> DataFrame:
    """Files of up to 100 customers: every fifth an ODS, some damaged (3 of 7) or inside an archive (5 of 7)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, rows in zip(b["file"].to_pylist(), (r.as_py() for r in b["rows"])):  # one book's rows at a time
                data = [[int(r["k"]), r["name"], None if r["k"] % 11 == 0 else float(r["bal"]), r["seg"]] for r in sorted(rows, key=lambda r: r["k"])]
                sheets = {"Contents": [["Contents"], ["Table 35", "Table 36"]], f"table_{file % 3}": [[TITLE], [], ["key", "name & no.", "balance", "<segment>"], *data]}
                body = (ods if file % 5 == 0 else xlsx)(sheets)
                if file % 7 == 5:
                    body = _zip({"notes/": "", "notes/readme.txt": "see tables", "tables/book.bin": body}, zipfile.ZIP_STORED)
                yield pa.RecordBatch.from_pydict({"path": [f"book-{file}"], "content": [body[: len(body) // 2] if file % 7 == 3 else body]})

    c = table(spark, sf, "customer")
    row = F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("bal"), F.col("c_mktsegment").alias("seg"))
    blocks = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("file")).agg(F.collect_list(row).alias("rows"))  # 100 rows a file at most
    return blocks.mapInArrow(build, "path string, content binary")


_FILES = "files AS (SELECT *, c_custkey // 100 AS file FROM customer)"


@query(f"""WITH {_FILES}
SELECT 'book-' || file AS file, CASE WHEN file % 7 = 5 THEN 'tables/book.bin' END AS member, 'table_' || CAST(file % 3 AS VARCHAR) AS sheet, '{TITLE}' AS title, CAST(3 + row_number() OVER (PARTITION BY file ORDER BY c_custkey) AS INTEGER) AS row,
  c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance, c_mktsegment AS segment FROM files WHERE file % 7 <> 3""")
def sheets_by_title(spark, sf):
    rows = workbooks.sheet_rows(books_of(spark, sf), title=r"^table 36:").where("row > 3 and cells['A'] is not null")
    return rows.select("file", "member", "sheet", "title", "row", F.expr("cells['A']").cast("bigint").alias("key"), F.expr("cells['B']").alias("name"), F.expr("cells['C']").cast("double").alias("balance"), F.expr("cells['D']").alias("segment"))


@query(f"""WITH {_FILES}, n AS (SELECT file, count(*) AS rows FROM files GROUP BY file)
SELECT 'book-' || file AS file, CASE WHEN file % 7 = 3 THEN NULL ELSE rows + CASE WHEN file % 5 = 0 THEN 7 ELSE 5 END END AS rows, CAST(CASE WHEN file % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS errors FROM n""")
def sheets_damaged(spark, sf):
    rows = workbooks.sheet_rows(books_of(spark, sf))
    return rows.groupBy("file").agg(F.nullif(F.count("row"), F.lit(0)).alias("rows"), F.count("error").alias("errors"))


@query("""WITH b AS (SELECT p_partkey AS k, p_name AS t FROM part)
SELECT 'body-' || k AS path, k % 6 IN (0, 1) AS ok, CASE WHEN k % 6 IN (2, 3, 5) THEN 'archived-body-is-binary' WHEN k % 6 = 4 THEN 'archived-body-is-html' END AS reason,
  CASE k % 6 WHEN 2 THEN 'pdf' WHEN 3 THEN 'zip/xlsx' WHEN 5 THEN 'gzip' END AS detail, CASE WHEN k % 6 = 0 THEN t WHEN k % 6 = 1 THEN t || ' é' END AS text FROM b""")
def archived_bodies(spark, sf):
    """A body for every part, by key modulo 6: text, gzipped text, pdf, zip, a page, a broken gzip."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(t.encode(), gzip.compress((t + " é").encode()), b"%PDF-1.4 " + t.encode(), _zip({"a": t}), b"<!DOCTYPE HTML><p>" + t.encode(), b"\x1f\x8b\x08\x00" + t.encode())[k % 6] for k, t in zip(b["k"], b["t"])]
            yield pd.DataFrame({"path": ["body-" + str(k) for k in b["k"]], "content": made})

    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("t"))
    return workbooks.bodies(parts.mapInPandas(build, "path string, content binary"))
