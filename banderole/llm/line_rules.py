"""Quality rules on words and on lines that recur across documents; DataFrame functions only.

Base rules look at one text.  The cross-document rule hashes normalised lines, counts for every
(host, line) the distinct documents that hold it, removes lines above the limits, and rejects
documents of which too little is left.  A document is an id; rows without one count by their text.

Scale: counts are combined map-side at both levels of the distinct count; only lines above the
limits are written and joined back, by broadcast if their table is small enough for the session's
threshold, else by a join whose large side Spark splits; texts never shuffle.

Edge cases: a null text is empty (no words, so it fails the base rules); null hosts are one host;
null ids and repeated rows are judged one by one; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

# Fixed values of the rules.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Lines of up to ``short_words`` words may recur in ``short_docs`` documents of a host, longer
    ones in ``long_docs``; a document must keep ``least_left`` of its words."""

    short_words: int = 3
    short_docs: int = 100
    long_docs: int = 10
    least_left: float = 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def with_base(docs: DataFrame, text: str = "t") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Repeated windows are found per text by sorting window hashes; a word counts once however many
    repeated windows cover it: with repeated starts p1 < p2 < ... that is sum(min(5, p[i+1] - p[i])).
    """
    t = F.col(text)
    out = docs.withColumn("_w", F.transform(words(t), lambda w: F.xxhash64(w)))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    window = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW)))),
    )
    out = out.withColumn("_g", window)
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    s = F.col("_s")
    twice = F.transform(
        s,
        lambda x, i: F.when(F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)), x["i"]),
    )
    out = out.withColumn("_p", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    p = F.col("_p")
    covered = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    out = out.withColumn("_l", lines_with_words(t))
    return out.withColumns(
        {
            "word_chars": _without(t, SPACE).cast("long"),
            "n_symbols": (F.length(t) - _without(t, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    ).drop("_w", "_g", "_s", "_p", "_l")


def normalised(line: Column) -> Column:
    """Lower case, digit runs as one zero, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACES, " "))


def _line_rows(docs: DataFrame) -> DataFrame:
    """(id, host, text_hash, doc, at, h, n): one row per line with words."""
    lines = F.transform(
        lines_with_words(F.col("t")), lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words(x)).alias("n"))
    )
    doc = F.when(F.col("id").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("id")).alias("doc")
    rows = docs.select("id", "host", F.xxhash64("t").alias("text_hash"), doc, F.posexplode(lines).alias("at", "line"))
    return rows.select("id", "host", "text_hash", "doc", "at", "line.h", "line.n")


def frequent_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, h, n_docs) of lines above the limits; ``docs`` has id, host, t."""
    counted = _line_rows(docs).groupBy("host", "h").agg(F.countDistinct("doc").alias("n_docs"), F.max("n").alias("n"))
    limit = F.when(F.col("n") <= limits.short_words, limits.short_docs).otherwise(limits.long_docs)
    return counted.where(F.col("n_docs") > limit).select("host", "h", "n_docs")


def judge(docs: DataFrame, *, key: str = "doc_id", host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: key, the base columns, n_removed_words and kept."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    frequent = materialise(frequent_lines(rows, limits).select("host", "h"), "frequent-lines")
    removed = (
        _line_rows(rows)
        .join(frequent, ["host", "h"])
        .groupBy("id", "host", "text_hash", "at")
        .agg(F.max("n").alias("n"))  # a repeated row must not count twice
        .groupBy("id", "host", "text_hash")
        .agg(F.sum("n").alias("n_removed_words"))
    )
    base = with_base(rows.withColumn("text_hash", F.xxhash64("t"))).drop("t").alias("b")
    r = removed.alias("r")
    same = F.col("b.id").eqNullSafe(F.col("r.id")) & (F.col("b.text_hash") == F.col("r.text_hash")) & (F.col("b.host") == F.col("r.host"))
    n = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    left = F.col("n_words") - n >= limits.least_left * F.col("n_words")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return base.join(r, same, "left").select(F.col("b.id").alias(key), *names, n.alias("n_removed_words"), (~F.col("base_failed") & left).alias("kept"))
