"""Figures read from the laid-out text of report pages: percentages, axes and legends by where they stand.

A chart comes out of a page's text as labels in columns.  Two shapes are read: years along the axis
with one label for each series beside each year (``by_year``), and pay bands along the axis with one year and sector in the caption
(``by_band``).  A token stands where it ends, at its percent sign, since axis labels are right-aligned.  Columns of ticks (four
different values or more, evenly spaced) are axes and go; every other percentage belongs to the nearest label.  What can't be
told for certain is refused with a reason, or kept as ``loose``, never guessed.

Everything happens inside a page's row with array functions: pages without a caption are filtered out first,
nothing is shuffled, a figure is read one time, and as one of bands only where its years can't be read.  A block has 60 lines at most by definition of the figure, whatever the page holds.

Edge cases: null and empty texts have no figure; a caption on the last line is a figure without a legend; of several captions on a page the
first counts; tokens at equal distance go to the first label, in equal places keep the order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a caption, a legend, a category line and a percentage look like.
CAPTION = r"(?i)Figure\s+(\d+\.\d+)\s*:\s*(.*?(?:difference|comparison).*?(?:remuneration|pay|salar).*?(?:private|public).*)"
SERIES = r"(?i)(?:deputy\s+director|director|permanent\s+secretary|scs\s*\d?)\s+(?:private|public)"
BANDS = r"(?i)deputy\s+director\s*1a|deputy\s+director|permanent\s+secretary|director"
YEAR = r"\b20\d{2}\b"
PERCENT = r"-?\d{1,3}\s*%"
YEAR_LINES, BAND_LINES, FAR = 60, 40, 22

_MARK = "\u0001"
_SPOT = "struct<text:string,start:int,end:int>"
_POINTS = "array<struct<series:string,year:int,pct:int>>"
_LOOSE = "array<struct<year:int,pct:int,x:int>>"


def spots(line: Column, pattern: str) -> Column:
    """array of (text, start, end): the matches of a pattern in a line and where they stand."""
    pieces = F.split(F.regexp_replace(F.translate(line, _MARK, " "), f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)

    def step(a: Column, p: Column) -> Column:
        after = a["at"] + F.length(p)
        found = F.concat(a["found"], F.array(F.struct(p.alias("text"), a["at"].alias("start"), after.alias("end"))))
        return F.struct(after.alias("at"), (a["i"] + 1).alias("i"), F.when(a["i"] % 2 == 1, found).otherwise(a["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(f"array<{_SPOT}>").alias("found"))
    return F.aggregate(pieces, start, step, lambda a: a["found"])


def times(line: Column, pattern: str) -> Column:
    """How many matches ``spots`` finds, without placing them."""
    return F.regexp_count(F.translate(line, _MARK, " "), F.lit(pattern))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blocks(pages: DataFrame, *, text: str = "text") -> DataFrame:
    """Pages with a caption of the gap figure: ``figure_no``, ``head`` (the caption's first line), ``next`` line and ``block``."""
    found = pages.where(F.rlike(F.col(text), F.lit(CAPTION))).withColumn("_lines", F.split(F.col(text), "\n"))
    hits = F.filter(F.transform("_lines", lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda s: F.rlike(s["l"], F.lit(CAPTION)))
    found = found.select("*", F.explode(F.array(F.get(hits, F.lit(0)))).alias("_at"))
    found = found.where("_at is not null")
    return found.select(
        *pages.columns,
        F.regexp_extract(F.col("_at.l"), CAPTION, 1).alias("figure_no"),
        F.trim(F.regexp_extract(F.col("_at.l"), CAPTION, 2)).alias("head"),
        F.trim(F.coalesce(F.get("_lines", F.col("_at.i") + 1), F.lit(""))).alias("next"),
        F.slice("_lines", F.col("_at.i") + 1, YEAR_LINES).alias("block"),
    )


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; an array function would compute it again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_with(block: Column, pattern: str) -> Column:
    """The matches on the first line with two or more of them that is neither a caption nor has percentages."""
    plain = F.filter(block, lambda l: ~F.rlike(l, F.lit(r"^\s*Figure\s+\d")) & ~F.contains(l, F.lit("%")))
    return F.get(F.transform(F.slice(F.filter(plain, lambda l: times(l, pattern) >= 2), 1, 1), lambda l: spots(l, pattern)), F.lit(0))


def _percentages(lines: Column) -> Column:
    """array of (v, x, n) in the order of the text."""
    flat = F.flatten(F.transform(F.filter(lines, lambda l: F.contains(l, F.lit("%"))), lambda l: spots(l, PERCENT)))
    return F.transform(flat, lambda t, n: F.struct(F.regexp_replace(t["text"], r"\s*%", "").cast("int").alias("v"), t["end"].alias("x"), n.alias("n")))


def _column(t: Column) -> Column:
    return F.floor(t["x"] / 3 + 0.5)  # a character of drift


def _ticks(vs: Column) -> Column:
    """Whether sorted different values are an axis: four or more, evenly spaced."""
    rest = F.greatest(F.size(vs) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(vs, 2, rest), F.slice(vs, 1, rest), lambda a, b: a - b)
    return (F.size(vs) >= 4) & (F.size(F.array_distinct(gaps)) == 1)


def _without_axes(all_tokens: Column) -> Column:
    """Tokens that don't stand in a column of four or more different, evenly spaced values."""

    def found(tokens: Column) -> Column:
        values = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: _column(t) == c), lambda t: t["v"])))
        axes = F.filter(F.array_distinct(F.transform(tokens, _column)), lambda c: let(values(c), _ticks))
        return let(axes, lambda bad: F.filter(tokens, lambda t: ~F.array_contains(bad, _column(t))))

    return let(all_tokens, found)


def _nearest(labels: Column, x: Column) -> Column:
    """(distance, place) of the label whose start is nearest to x, the first of equals."""
    return F.array_min(F.transform(labels, lambda l, i: F.struct(F.abs(l["start"] - x).alias("far"), i.alias("i"))))


def by_year(block: Column) -> Column:
    """struct of points, loose values and why there are none, for a figure with years along the axis."""

    def axis(counts: Column) -> Column:
        most = F.array_max(counts)
        return F.struct(most.alias("most"), F.element_at(block, F.array_position(counts, most).cast("int")).alias("line"))

    def group(g: Column, i: Column, series: Column, placed: Column, distinct: Column, each: Column) -> Column:
        """The labels of one year, left to right, for the series of its panel."""
        panel = F.floor(i / distinct)
        low, high = F.floor(panel * each).cast("int"), F.least(F.floor((panel + 1) * each).cast("int"), F.size(series))
        mine = F.transform(F.slice(series, low + 1, F.greatest(high - low, F.lit(0))), lambda s: squeezed(s["text"]))
        vals = F.array_sort(F.filter(placed, lambda t: t["start"] == g["x"]))

        def dealt(v: Column) -> Column:
            near = F.array_sort(F.transform(v["vals"], lambda t, k: F.struct(F.abs(t["x"] - g["x"]).alias("far"), k.alias("k"))))
            return let(F.struct(v["mine"].alias("mine"), v["vals"].alias("vals"), F.transform(F.slice(near, 1, F.size(v["mine"])), lambda s: s["k"]).alias("chosen")), settled)

        def settled(v: Column) -> Column:
            whole = F.size(v["chosen"]) == F.size(v["mine"])
            kept = F.filter(v["vals"], lambda t, k: F.array_contains(v["chosen"], k))
            points = F.zip_with(v["mine"], kept, lambda m, t: F.struct(m.alias("series"), g["year"].alias("year"), t["v"].alias("pct")))
            rest = F.filter(v["vals"], lambda t, k: ~whole | ~F.array_contains(v["chosen"], k))
            loose = F.transform(rest, lambda t: F.struct(g["year"].alias("year"), t["v"].alias("pct"), t["x"].alias("x")))
            return F.struct(F.when(whole, points).otherwise(F.array().cast(_POINTS)).alias("points"), loose.alias("loose"))

        return let(F.struct(mine.alias("mine"), vals.alias("vals")), dealt)

    def read(v: Column) -> Column:
        """v: series, years, most and data."""

        def panels(p: Column) -> Column:
            placed, groups = p["placed"], p["groups"]
            distinct = F.greatest(F.size(F.array_distinct(F.transform(groups, lambda g: g["year"]))), F.lit(1))
            each = F.size(v["series"]) / F.greatest(F.lit(1.0), F.floor(F.size(groups) / distinct + 0.5))
            return let(F.struct(distinct.alias("d"), each.alias("e")), lambda n: F.transform(groups, lambda g, i: group(g, i, v["series"], placed, n["d"], n["e"])))

        placed = F.transform(v["data"], lambda t: let(F.get(v["years"], _nearest(v["years"], t["x"])["i"]), lambda at: F.struct(t["x"], t["n"], t["v"], at["start"].alias("start"), at["year"].alias("year"))))
        groups = lambda ps: F.array_sort(F.array_distinct(F.transform(ps, lambda t: F.struct(t["start"].alias("x"), t["year"].alias("year")))))
        parts = let(placed, lambda ps: let(F.struct(ps.alias("placed"), groups(ps).alias("groups")), panels))
        return let(parts, lambda r: outcome(v, F.flatten(F.transform(r, lambda g: g["points"])), F.flatten(F.transform(r, lambda g: g["loose"]))))

    def outcome(v: Column, points: Column, loose: Column) -> Column:
        why = F.when(v["series"].isNull(), "no legend").when(v["most"] < 2, "no year axis").when(F.size(v["data"]) == 0, "no labels beside the axis").when(F.size(points) == 0, "no year has a label for each series")
        return F.struct(F.array_sort(points).alias("points"), loose.alias("loose"), why.alias("why"))

    years = lambda line: F.transform(spots(line, YEAR), lambda s: F.struct(s["text"].cast("int").alias("year"), s["start"].alias("start")))
    gathered = lambda a: F.struct(
        _first_with(block, SERIES).alias("series"), years(a["line"]).alias("years"), a["most"].alias("most"), _without_axes(_percentages(F.filter(block, lambda l: l != a["line"]))).alias("data")
    )
    return let(let(let(F.transform(block, lambda l: times(l, YEAR)), axis), gathered), read)


def by_band(block: Column, caption: Column) -> Column:
    """struct of points, loose values and why there are none, for a figure with pay bands along the axis."""
    private, public = F.rlike(caption, F.lit("(?i)private")), F.rlike(caption, F.lit("(?i)public"))
    sector = F.when(private & ~public, "Private").when(public & ~private, "Public")
    year = F.regexp_extract(caption, YEAR, 0).try_cast("int")

    def near(v: Column) -> Column:
        left = F.array_min(F.transform(v["cats"], lambda c: c["start"])) - 2
        data = let(left, lambda edge: F.filter(v["tokens"], lambda t: t["x"] >= edge))
        return let(F.transform(data, lambda t: F.struct(t["v"], t["x"], _nearest(v["cats"], t["x"]).alias("at"))), lambda ps: outcome(v, ps))

    def outcome(v: Column, placed: Column) -> Column:
        name = lambda t: F.concat_ws(" ", squeezed(F.get(v["cats"], t["at"]["i"])["text"]), v["sector"])
        points = F.transform(F.filter(placed, lambda t: t["at"]["far"] <= FAR), lambda t: F.struct(name(t).alias("series"), v["year"].alias("year"), t["v"].alias("pct")))
        loose = F.transform(F.filter(placed, lambda t: t["at"]["far"] > FAR), lambda t: F.struct(v["year"].alias("year"), t["v"].alias("pct"), t["x"].alias("x")))
        return let(F.struct(points.alias("points"), loose.alias("loose")), lambda r: F.struct(
            F.array_sort(r["points"]).alias("points"), r["loose"].alias("loose"),
            F.when(v["year"].isNull(), "no year in the caption").when(v["sector"].isNull(), "not one sector").when(v["cats"].isNull(), "no bands")
            .when(F.size(placed) == 0, "no labels beside the axis").when(F.size(r["points"]) == 0, "no label near a band").alias("why"),
        ))

    return let(F.struct(_first_with(block, BANDS).alias("cats"), _without_axes(_percentages(block)).alias("tokens"), sector.alias("sector"), year.alias("year")), near)


def read(pages: DataFrame, *, text: str = "text") -> DataFrame:
    """One row for each page with a caption: number, caption, shape, points (series, year, pct), loose values, source, note; or why it is refused."""
    found = blocks(pages, text=text)
    runs_on = (F.col("next") != "") & ~F.contains("next", F.lit("%")) & ~F.rlike("next", F.lit("(?i)^Source"))
    whole = lambda wraps: F.concat("head", F.when(wraps, F.concat(F.lit(" "), "next")).otherwise(""))
    short, band = whole(runs_on & (F.length("next") < 120)), whole(runs_on)
    # generators keep each reading a column of its own: filters on its parts would else compute it again for each of them
    df = found.select("*", F.explode(F.array(by_year(F.col("block")))).alias("_year"))
    other = F.when(F.col("_year.why").isNotNull(), let(F.slice("block", 1, BAND_LINES), lambda part: by_band(part, band)))
    df = df.select("*", F.explode(F.array(other)).alias("_band"))
    year = F.col("_year.why").isNull()
    by = ~year & F.col("_band.why").isNull()
    lines = F.when(~year & by, F.slice("block", 1, BAND_LINES)).otherwise(F.col("block"))

    def notes(ls: Column) -> Column:
        at = F.transform(ls, lambda l, i: F.when(F.rlike(l, F.lit(r"(?i)^\s*Note:")), i))
        note = let(F.array_min(at), lambda i: F.when(i.isNotNull(), squeezed(F.array_join(F.slice(ls, i + 1, 5), " "))))
        return F.struct(squeezed(F.get(F.filter(ls, lambda l: F.rlike(l, F.lit(r"(?i)^\s*Source:"))), F.lit(0))).alias("source"), note.alias("note"))

    chosen = F.when(year, F.col("_year")).when(by, F.col("_band"))
    return df.select(
        *(c for c in pages.columns if c != text),
        "figure_no",
        F.when(~year & by, band).otherwise(short).alias("caption"),
        F.when(year, "year-axis").when(by, "band-axis").alias("shape"),
        chosen["points"].alias("points"),
        chosen["loose"].alias("loose"),
        let(lines, notes).alias("_notes"),
        F.when(~year & ~by, F.concat_ws("; ", F.col("_year.why"), F.col("_band.why"))).alias("refused"),
    ).withColumns({"source": F.col("_notes.source"), "note": F.col("_notes.note")}).drop("_notes")


def points(figures: DataFrame, *keys: str) -> DataFrame:
    """(keys, figure_no, series, year, pct): one row a reading."""
    return figures.select(*keys, "figure_no", F.inline("points"))


def broken_anchors(readings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Values that must still read as published and don't: (edition, series, year, pct, got).

    ``anchors`` has edition, series, year, pct; a reading that is missing has null in ``got``.  An empty result lets a run go on.
    """
    on = ["edition", "series", "year"]
    got = readings.groupBy(*on).agg(F.min("pct").alias("got"))
    return anchors.join(got, on, "left").where(~F.col("got").eqNullSafe(F.col("pct")))
