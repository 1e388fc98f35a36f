"""Text retrieval: tokens, BM25 ranking, snippet lines, items of web pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import once

K1, B = 1.5, 0.75
# Words that never count, and the characters of a token.
STOP = "the a an and or of to in for on is are was were be been by with as at from that this it its".split()
KEPT = "a-z0-9£%.\\-"


def tokens(text: Column, keep: str = KEPT) -> Column:
    """Lower-case runs of the kept characters, longer than one, without stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{keep}]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP))


def bm25(docs: DataFrame, query: str, *, key: str = "doc_id", text: str = "text", k: int | None = 8) -> DataFrame:
    """(key, score) of documents that score above zero, best first, ties by key; all without ``k``.

    Every text is split once; of its tokens only the asked ones are kept, beside its length, in a small
    table that serves the statistics and the scores.  What is broadcast is one count per query term
    and two corpus statistics.  A query word that is given twice counts twice.
    """
    words = re.sub(f"[^{KEPT}]+", " ", query.lower()).split()
    asked = [w for w in words if len(w) > 1 and w not in STOP]
    times = {w: asked.count(w) for w in dict.fromkeys(asked)}
    if not times:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    wanted = F.array(*map(F.lit, times))
    t = docs.select(key, tokens(F.col(text)).alias("t"))
    hits = once(t.select(key, F.size("t").alias("len"), F.filter("t", lambda w: F.array_contains(wanted, w)).alias("hit")))
    corpus = hits.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    each = hits.select(F.explode(F.array_distinct("hit")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    found = each.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("dfs"))  # one entry a query term
    asked_times = F.create_map(*(F.lit(x) for pair in times.items() for x in pair))

    def part(w: Column) -> Column:
        tf, df = F.size(F.filter("hit", lambda x: x == w)), F.col("dfs")[w]
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return asked_times[w] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))

    score = F.aggregate(F.array_distinct("hit"), F.lit(0.0), lambda a, w: a + part(w))
    out = hits.where(F.size("hit") > 0).join(F.broadcast(found)).join(F.broadcast(corpus)).select(key, score.alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def token_stats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, tf, df): occurrences and documents; both from one combined pass."""
    each = docs.select(F.col(key).alias("row"), F.explode(tokens(F.col(text))).alias("token"))
    per_doc = each.groupBy("row", "token").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").cast("long").alias("tf"), F.count("*").alias("df"))


def snippets(docs: DataFrame, words: list[str], *, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """(key, line_no, line, hits): a document's lines with the most query words."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    hit = lambda w: F.contains(F.lower(F.col("line")), F.lit(w)).cast("int")
    scored = lines.withColumn("hits", sum((hit(w) for w in words[1:]), hit(words[0]))).where("hits > 0")
    w = Window.partitionBy(key).orderBy(F.desc("hits"), "line_no")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def items(pages: DataFrame, pattern: str, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, item): what the pattern's first group holds at each of its matches."""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "item"))


# The entities that the pages' plain parts use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&pound;", "£"), ("&amp;", "&"))


MARKUP = tuple(e for e in ENTITIES if e[0] in ("&lt;", "&gt;", "&amp;"))


def unescaped(c: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    for name, char in entities:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def stripped(html: Column, *, entities: tuple[tuple[str, str], ...] = ENTITIES, space: str = "\\s+") -> Column:
    """Text without tags, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(html, "<[^>]*>", " "), entities), space, " "))


def table_rows(html: Column) -> Column:
    """array of rows, each an array of stripped cells."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: stripped(c)))
