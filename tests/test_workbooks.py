"""Workbooks and archives through the data source and from bodies: round trips, splits, damage."""

import gzip
import io
import zipfile

import pytest

from banderole.plans.books import _zip, ods, xlsx
from banderole.sources import workbooks

SHEETS = {"Notes": [["Contents"], ["see Table 9"]], "t1": [["Table 9: Pay & grades"], [], ["a<b", 1.5, None, "x é"], ["", 7, "s", "end"]], "big": [[f"r{i}", i] for i in range(500)]}
WANT = [{"A": "Table 9: Pay & grades"}, {}, {"A": "a<b", "B": "1.5", "D": "x é"}, {"B": "7", "C": "s", "D": "end"}]


@pytest.mark.parametrize("make", [xlsx, ods])
def test_rows_of_a_sheet_found_by_its_printed_title(make):
    rows = [r for r in workbooks.rows_of("f", None, make(SHEETS), title="^table 9:") if r[5]  or r[4] <= 4]
    assert [r[5] for r in rows][:4] == WANT
    assert {(r[1], r[2], r[3], r[6]) for r in rows} == {(None, "t1", "Table 9: Pay & grades", None)}
    by_name = list(workbooks.rows_of("f", None, make(SHEETS), sheet="big"))
    assert [r[5] for r in by_name][:500] == [{"A": f"r{i}", "B": str(i)} for i in range(500)]
    assert list(workbooks.rows_of("f", None, make(SHEETS), title="nowhere")) == []


def test_repeats_covered_cells_and_filler():
    body = (
        '<d xmlns:office="o" xmlns:table="t" xmlns:text="x"><table:table table:name="s"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="3" office:value="4"/><table:covered-table-cell/>'
        '<table:table-cell><text:p>one <text:span>two</text:span></text:p><text:p>three</text:p></table:table-cell><table:table-cell table:number-columns-repeated="16000"><text:p>w</text:p></table:table-cell></table:table-row>'
        '<table:table-row table:number-rows-repeated="21"/></table:table></d>'
    )
    rows = [r[5] for r in workbooks.rows_of("f", None, _zip({"content.xml": body}))]
    assert rows == [{"A": "4", "B": "4", "C": "4", "E": "one two three", "F": "w"}] * 2 + [{}]


def test_shared_strings_without_phonetic_runs_and_bad_indexes():
    book = _zip({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="s" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><r><t>ab</t></r><r><t>c</t></r><rPh><t>zzz</t></rPh></si><si/></sst>",
        "xl/worksheets/s.xml": '<worksheet><sheetData><row><c r="AB1" t="s"><v>0</v></c><c r="AC1" t="s"><v>1</v></c><c r="AD1" t="s"><v>9</v></c><c><v>5</v></c></row><row/></sheetData></worksheet>',
    })
    assert [r[5] for r in workbooks.rows_of("f", None, book)] == [{"AB": "abc"}, {}]
    assert [workbooks.letters(k) for k in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]


def test_damage_gives_error_rows_after_what_is_whole():
    book = xlsx({"big": [[f"r{i}", i] for i in range(3_000)]})
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = parts["xl/worksheets/sheet1.xml"]
    parts["xl/worksheets/sheet1.xml"] = sheet[: len(sheet) // 2]
    rows = list(workbooks.rows_of("f", None, _zip(parts)))
    assert 1_000 < len(rows) < 2_999 and rows[-1][6].startswith("ParseError") and all(r[6] is None for r in rows[:-1])
    for body in (None, b"", b"PK\x03\x04 no archive", b"plain", book[:-30]):
        (only,) = workbooks.rows_of("f", None, body)
        assert only[6] and only[5] is None
    outer = _zip({"good.xlsx": xlsx(SHEETS), "bad.xlsx": book[:400], "a.txt": "text", "dir/": ""})
    rows = list(workbooks.rows_of("f", None, outer, title="^table 9:"))
    assert [r[1] for r in rows if r[6]] == ["bad.xlsx"] and [r[5] for r in rows if r[1] == "good.xlsx"] == WANT


def test_data_source_splits_archives_by_member(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    members = {f"m{k}.xlsx": xlsx({"t": [["Table 9: x"], [k, "v"]]}) for k in range(5)}
    (tmp_path / "deep" / "outer.zip").write_bytes(_zip(members, zipfile.ZIP_STORED))
    (tmp_path / "one.ods").write_bytes(ods(SHEETS))
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04")
    (tmp_path / "_hidden.xlsx").write_bytes(b"no")
    workbooks.register(spark)
    df = spark.read.format("workbook").option("splitBytes", 1_000).option("title", "^table 9:").load(str(tmp_path))
    assert df.rdd.getNumPartitions() >= 6
    got = sorted((r["file"].rsplit("/", 1)[1], r["member"] or "", r["row"] or 0, (r["cells"] or {}).get("A"), r["error"] is not None) for r in df.collect())
    assert [g for g in got if g[0] == "outer.zip"] == sorted(x for k in range(5) for x in (("outer.zip", f"m{k}.xlsx", 1, "Table 9: x", False), ("outer.zip", f"m{k}.xlsx", 2, str(k), False)))
    assert [g[4] for g in got if g[0] == "bad.xlsx"] == [True]
    assert [g[3] for g in got if g[0] == "one.ods"][:4] == ["Table 9: Pay & grades", None, "a<b", None]
    whole = spark.read.format("workbook").option("title", "^table 9:").load(f"file://{tmp_path}")
    key = lambda d: sorted(str(r) for r in d.collect())
    assert key(whole) == key(df)
    files = spark.read.format("binaryFile").load([str(tmp_path / "one.ods"), str(tmp_path / "bad.xlsx"), str(tmp_path / "deep")])
    assert workbooks.sheet_rows(files, title="^table 9:").count() == df.count()


def test_bodies(spark):
    rows = [("a", b"x,y\n1,2"), ("b", gzip.compress("p\xa3".encode("cp1252"))), ("c", b"%PDF-1"), ("d", b" <HTML lang=x>"), ("e", b"\x1f\x8b\x08broken"), ("f", None), ("g", gzip.compress(b"PK\x03\x04zip")), ("h", b"<header>")]
    got = {r["path"]: (r["ok"], r["reason"], r["detail"], r["text"]) for r in workbooks.bodies(spark.createDataFrame([(p, bytearray(b) if b is not None else None) for p, b in rows], "path string, content binary")).collect()}
    assert got == {
        "a": (True, None, None, "x,y\n1,2"), "b": (True, None, None, "p£"), "c": (False, "archived-body-is-binary", "pdf", None), "d": (False, "archived-body-is-html", None, None),
        "e": (False, "archived-body-is-binary", "gzip", None), "f": (True, None, None, ""), "g": (False, "archived-body-is-binary", "zip/xlsx", None), "h": (True, None, None, "<header>"),
    }


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string, content binary")
    assert workbooks.sheet_rows(none).count() == 0 and workbooks.bodies(none).count() == 0
