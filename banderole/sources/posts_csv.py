"""Published post files: ragged CSV in any of the usual encodings, to typed post rows.

Whole files are the unit of parsing (quotes may span lines and a lone CR ends a line), so bytes
become cells in Arrow-batched tasks, which hold one file's text and some thousand of its rows; all
rules on cells are columns of the plan.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as c

# Phrases by which a header cell names a field, in the order they are tried.
FIELDS = {
    "pur": ("post unique reference", "post reference", "unique reference"),
    "name": ("name",),
    "grade": ("grade equivalent", "grade", "scs grade"),
    "title": ("job title", "post title", "title"),
    "group": ("professional occupational group", "profession", "occupational group"),
    "floor": ("actual pay floor", "pay floor", "payscale minimum", "salary min"),
    "ceil": ("actual pay ceiling", "pay ceiling", "payscale maximum", "salary max"),
    "fte": ("fte",),
    "unit": ("unit", "group"),
    "organisation": ("organisation", "organization"),
    "parent": ("parent department",),
    "reports_to": ("reports to senior post", "reports to"),
    "cost": ("salary cost of reports",),
    "region": ("office region", "region"),
}
JUNIOR_HEADERS = ("reporting senior post", "number of posts", "generic job title")
MAGIC = (("25504446", "pdf"), ("504B0304", "zip/xlsx"), ("D0CF11E0", "xls"), ("1F8B", "gzip"))


def sniff(content: Column) -> Column:
    """What binary format a file's first bytes show, or null."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(F.octet_length(content) < 4, F.lit(None))
    for magic, name in MAGIC:
        out = out.when(head.startswith(magic), name)
    return out


def norm_header(h: str) -> str:
    return re.sub("[^a-z0-9]+", " ", (h or "").lower()).strip()


def find_column(headers: list[str], phrases: tuple[str, ...]) -> int:
    """The first header with all words of a phrase, phrases in order; else one that contains it."""
    norm = [norm_header(h) for h in headers]
    sets = [set(n.split()) for n in norm]
    for test in (lambda p, i: set(p.split()) <= sets[i], lambda p, i: norm_header(p) in norm[i]):
        for p in phrases:
            for i in range(len(norm)):
                if test(p, i):
                    return i
    return -1


def find_exact(headers: list[str], phrases: tuple[str, ...]) -> int:
    """The first header that is a phrase or starts with it and a space."""
    norm = [norm_header(h) for h in headers]
    return next((i for p in phrases for i, n in enumerate(norm) if n == p or n.startswith(p + " ")), -1)


def is_junior(headers: list[str]) -> bool:
    return any(p in norm_header(h) for h in headers for p in JUNIOR_HEADERS)


def decode(body: bytes) -> str:
    """Strict UTF-8, else Windows-1252; undefined bytes become U+FFFD."""
    try:
        return body.decode("utf-8-sig")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def rows_in(text: str) -> Iterator[list[str]]:
    """Rows of a CSV text, one at a time; CRLF and lone CR are line ends, inside quotes too."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    csv.field_size_limit(1 << 30)

    def lines() -> Iterator[str]:
        at = 0
        while at < len(text):
            end = text.find("\n", at) + 1 or len(text)
            yield text[at:end]
            at = end

    return csv.reader(lines(), strict=False)


def cells(text: str) -> list[list[str]]:
    return list(rows_in(text))


def opened(content: bytes) -> tuple[list[str], Iterator[list[str]] | None]:
    """(header, data rows); None instead of rows where there are none."""
    rows = rows_in(decode(content))
    head, first = next(rows, []), next(rows, None)
    return head, None if first is None else chain([first], rows)


def batched(rows: Iterator[list], schema: str, most: int = 5_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, never a whole file of them at once."""
    columns = [c.split() for c in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kinds[kind]) for i, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])


def file_rows(files: DataFrame, of, schema: str) -> DataFrame:
    """``of(path, content)``, an iterator of rows, for each of (path, content); a file's bytes are taken from its batch when its turn comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield from batched(of(path.as_py(), content.as_py()), schema)

    return files.select("path", "content").mapInArrow(run, schema)


RAW = "file string, reason string, row_idx int, valid_flag string, has_valid boolean, " + ", ".join(f"{f} string" for f in FIELDS)


def _raw(file: str, content: bytes) -> Iterator[list]:
    head, rows = opened(content)
    at = {f: find_column(head, p) for f, p in FIELDS.items()}
    reason = None
    if rows is None:
        reason = "empty"
    elif is_junior(head):
        reason = "junior-schema"
    elif at["floor"] < 0 and at["ceil"] < 0:
        reason = "no-pay-columns"
    elif at["grade"] < 0 and at["title"] < 0:
        reason = "no-post-columns"
    if reason:
        yield [file, reason, *[None] * (len(FIELDS) + 3)]
        return
    valid = next((i for i, h in enumerate(head) if norm_header(h) == "valid"), -1)
    wide, order = max(valid, *at.values()) + 1, [valid, *at.values()]
    for k, r in enumerate(rows):
        r += [""] * (wide - len(r))
        flag, *fields = [r[i].strip() if i >= 0 else "" for i in order]
        yield [file, None, k, flag, valid >= 0, *fields]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One row per data row of every file, or one with the reason that a file was refused."""
    return raw_rows(spark.read.format("binaryFile").load(path).select("path", "content"))


def raw_rows(files: DataFrame) -> DataFrame:
    return file_rows(files, _raw, RAW)


def normalise(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts, files): typed post rows, and per file its reason (null if it counts) and counts.

    File-level verdicts of the posts are counts over each file's window, so a file is parsed once for them;
    ``files`` groups the same counts. A refused file never sinks the rest.
    """
    blank = (F.col("grade") == "") & (F.col("title") == "") & (F.col("name") == "") & (F.col("floor") == "") & (F.col("ceil") == "") & (F.col("pur") == "")
    pay = (c.money(F.col("floor")) > 0) | (c.money(F.col("ceil")) > 0)
    rows = raw.withColumns({"g": c.grade(F.col("grade")), "blank": F.coalesce(blank, F.lit(False)), "flagged": F.lower(F.trim("valid_flag")).isin("0", "no", "n", "false"), "pay": pay})
    kept = F.col("reason").isNull() & ~F.col("blank")
    big = F.regexp_replace("fte", "[^0-9.]", "").try_cast("double") > 5
    n = lambda t: F.count_if(F.coalesce(t, F.lit(False)))
    counts = {
        "gate": F.max("reason"),
        "kept_rows": n(kept),
        "pay_valid": n(kept & F.col("pay") & ~F.col("flagged") & F.col("has_valid")),
        "pay_invalid": n(kept & F.col("pay") & F.col("flagged") & F.col("has_valid")),
        "graded": n(kept & (F.col("g.band") != "Other / Not stated")),
        "senior": n(kept & F.col("g.senior")),
        "big_fte": n(kept & big),
    }
    many = F.try_divide("big_fte", "kept_rows") > 0.5
    few = F.coalesce(F.try_divide("senior", "graded"), F.lit(0.0)) < 0.2
    verdicts = {
        "refusal": F.coalesce(
            "gate",
            F.when(F.col("kept_rows") == 0, "all-rows-blank")
            .when((F.col("graded") >= 20) & (F.col("senior") == 0), "junior-content")
            .when((F.col("kept_rows") >= 20) & many & few, "junior-content-fte"),
        ),
        "valid_applied": (F.col("pay_valid") > F.col("pay_invalid")) & (F.col("pay_valid") > 0),
    }
    read = F.col("reason").isNull()
    seen = {"data_rows": n(read), "blank_rows": n(read & F.col("blank"))}
    files = rows.groupBy("file").agg(*(x.alias(k) for k, x in (seen | counts).items())).withColumns(verdicts).withColumnRenamed("refusal", "reason").drop("gate")
    whole = Window.partitionBy("file")
    judged = rows.where(kept | F.col("reason").isNotNull()).withColumns({k: x.over(whole) for k, x in counts.items()}).withColumns(verdicts)
    ok = judged.where(kept & F.col("refusal").isNull() & ~(F.col("valid_applied") & F.col("flagged")))
    title, prof, pay2 = F.col("title"), c.profession(F.col("group"), F.col("title")), c.disclosure(F.col("floor"), F.col("ceil"))
    out = ok.withColumns({"p": prof, "d": pay2, "ref": c.identifier(F.col("pur"))})
    w = Window.partitionBy("file", "ref").orderBy("row_idx")
    posts = out.select(
        "file",
        "row_idx",
        F.col("ref").alias("pur"),
        F.when(F.col("ref") != "", F.row_number().over(w) - 1).otherwise(0).cast("int").alias("ordinal"),
        c.status(F.col("name")).alias("status"),
        c.holder(F.col("name")).alias("holder"),
        F.substring(title, 1, 160).alias("title"),
        F.substring("unit", 1, 120).alias("unit"),
        F.substring("organisation", 1, 120).alias("organisation"),
        F.substring("parent", 1, 120).alias("parent_dept"),
        c.identifier(F.col("reports_to")).alias("reports_to"),
        c.half_up(c.money(F.col("cost"))).alias("cost_of_reports"),
        F.substring("region", 1, 60).alias("region"),
        F.col("g.raw").alias("grade_raw"),
        F.col("g.band").alias("grade"),
        F.col("g.variant").alias("variant"),
        F.col("p.raw").alias("prof_raw"),
        F.col("p.prof").alias("prof"),
        F.col("p.source").alias("prof_source"),
        c.is_digital(F.col("p.prof"), title).alias("ddat"),
        c.is_policy(F.col("p.prof"), title).alias("pol"),
        c.fte(F.col("fte")).alias("fte"),
        F.col("d.floor").alias("floor"),
        F.col("d.ceil").alias("ceil"),
        F.col("d.disclosed").alias("disclosed"),
        F.col("d.reason").alias("withheld_reason"),
        F.col("d.bin_low").alias("bin_low"),
        F.col("d.bin_high").alias("bin_high"),
    )
    return posts, files


def write_csv(df: DataFrame, path: str) -> None:
    """CRLF lines, quoted where needed, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


