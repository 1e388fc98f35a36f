"""Personal data by candidate gradient boosting; DataFrame functions only.

Four base patterns always count.  Beside them, high-recall generators propose overlapping spans
(national phone numbers, card-like digit runs, obfuscated addresses, credential-like tokens);
boosted trees over format and context features score each, and those at or above their kind's
calibrated threshold are redacted too, unless they lie inside a base span.

The trees are trained on the driver in numpy, on generated labelled candidates (their number and
seed are parameters; no table is read), and become one SQL expression.  A kind's threshold is the
least one whose precision on held-out candidates of that kind reaches ``PRECISION``.

Spans are 0-based code points, end exclusive.  Patterns are written with look-behind and
possessive repeats so that each finds exactly the leftmost non-overlapping matches of the plain
pattern in linear time, and only those long enough to matter.  Repeats of groups are possessive,
or Java would recurse once a repeat and overflow its stack on long texts.

Edge cases: null and empty texts have no spans; null ids and repeated rows are handled one by one;
an empty table gives no rows; work grows in proportion to a text and its spans (running values are made in
blocks, contexts and redacted pieces never from the text's start); spans that start together are ordered by kind; extra columns pass
through ``redact`` (names that start with ``_pii_`` are reserved).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, the patterns and what a match must pass.
KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

GENERATORS = {
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",
}
LONGEST = 19  # digits of a card number; longer runs have no check digit
CONTEXT = 24
CUES = {
    "cue_phone": "(?i)tel|phone|call|mobile|fax",
    "cue_card": "(?i)card|visa|credit|iban|account",
    "cue_mail": "(?i)mail|contact|write",
    "cue_secret": "(?i)passw|token|secret|key|auth|credential",
}
FEATURES = ("kind", "length", "digits", "letters", "uppers", "marks", "luhn", "assigned", *CUES)


# --- features, twice: for training and as SQL ---------------------------------------------------
def luhn_ok(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def features_of(kind: str, match: str, left: str) -> list[float]:
    import re

    digits = re.sub("[^0-9]", "", match)
    letters = re.sub("[^A-Za-z]", "", match)
    return [
        KINDS.index(kind),
        len(match),
        len(digits),
        len(letters),
        len(re.sub("[^A-Z]", "", match)),
        len(match) - len(digits) - len(letters),
        float(len(digits) <= LONGEST and luhn_ok(digits)),
        float(bool(re.search("[=:]\\s*[\"']?$", left))),
        *(float(bool(re.search(p, left))) for p in CUES.values()),
    ]


def _count(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def luhn(digits: Column) -> Column:
    """Whether a digit string's Luhn sum is a multiple of ten."""
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.coalesce(F.try_to_number(digits.substr(n - i + 1, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def feature_columns(kind: Column, match: Column, left: Column) -> dict[str, Column]:
    digits = F.regexp_replace(match, "[^0-9]", "")
    short = F.length(digits) <= LONGEST
    out = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1,
        "length": F.length(match),
        "digits": F.length(digits),
        "letters": _count(match, "[^A-Za-z]"),
        "uppers": _count(match, "[^A-Z]"),
        "luhn": (short & luhn(F.when(short, digits).otherwise("0"))).cast("int"),
        "assigned": left.rlike("[=:]\\s*[\"']?$").cast("int"),
        **{name: left.rlike(p).cast("int") for name, p in CUES.items()},
    }
    out["marks"] = out["length"] - out["digits"] - out["letters"]
    return out


# --- boosted trees ------------------------------------------------------------------------------
@dataclass(frozen=True)
class Tree:
    """Depth two: a root test, then one test on each side; value[side][side]."""

    tests: tuple  # ((feature, cut), (feature, cut), (feature, cut))
    values: tuple  # ((v00, v01), (v10, v11))

    def predict(self, x: np.ndarray) -> np.ndarray:
        (f, c), *below = self.tests
        side = x[:, f] > c
        out = np.empty(len(x))
        for s in (False, True):
            g, d = below[s]
            out[side == s] = np.where(x[side == s, g] > d, self.values[s][1], self.values[s][0])
        return out

    def column(self, features: dict[str, Column]) -> Column:
        (f, c), *below = self.tests

        def leafs(s: int) -> Column:
            g, d = below[s]
            return F.when(features[FEATURES[g]] > d, self.values[s][1]).otherwise(self.values[s][0])

        return F.when(features[FEATURES[f]] > c, leafs(1)).otherwise(leafs(0))


def _best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    best, found = -1.0, (0, np.inf)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            r = x[:, f] > c
            gain = g[r].sum() ** 2 / (h[r].sum() + 1) + g[~r].sum() ** 2 / (h[~r].sum() + 1)
            if gain > best:
                best, found = gain, (f, float(c))
    return found


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, rate: float = 0.4) -> tuple[float, list[Tree]]:
    """Newton boosting of the log loss with depth-two trees."""
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        tests = [_best_cut(x, g, h)]
        side, values = x[:, tests[0][0]] > tests[0][1], []
        for s in (False, True):
            at = side == s
            f, c = _best_cut(x[at], g[at], h[at]) if at.any() else (0, np.inf)
            tests.append((f, c))
            hi = at & (x[:, f] > c)
            lo = at & ~(x[:, f] > c)
            values.append(tuple(float(rate * g[k].sum() / (h[k].sum() + 1)) for k in (lo, hi)))
        trees.append(Tree(tuple(tests), tuple(values)))
        margin += trees[-1].predict(x)
    return start, trees


PRECISION = 0.995


def generate_candidates(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``n`` generated candidates, half of them personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    text = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    low, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

    def card(good: bool) -> str:
        d = pick("4", "5", "37", "6") + text(digits, int(rng.integers(13, 16)))
        fit = next(c for c in digits if luhn_ok(d[:-1] + c))
        d = d[:-1] + (fit if good else str((int(fit) + int(rng.integers(1, 10))) % 10))
        return pick(d, "-".join(d[k : k + 4] for k in range(0, len(d), 4)), " ".join(d[k : k + 4] for k in range(0, len(d), 4)))

    rows, labels = [], []
    for i in range(n):
        y, words = i % 2, " ".join(text(low, int(rng.integers(2, 9))) for _ in range(4)) + " "
        kind = pick("phone", "card", "email", "secret")
        if kind == "phone":
            a = [text(digits, k) for k in (3, 3, 4)]
            match = pick("({}) {}-{}", "({}) {} {}", "{}-{}-{}").format(*a) if y else pick("{} {} {}", "{}.{}.{}", "{}-{}-{}").format(*(text(digits, int(k)) for k in rng.integers(3, 5, 3)))
            left = words + pick("tel ", "phone: ", "call ", "mobile ") if y else words + pick("", "", "no ", "isbn ", "version ", "order ")
        elif kind == "card":
            match, left = card(bool(y)), words + (pick("card ", "visa ", "credit card: ", "account ") if y else pick("", "order ", "id ", "serial "))
        elif kind == "email":
            match, left = f"{text(low, 6)} {pick('(at)', '[at]')} {text(low, 7)}.{pick('com', 'org', 'net')}", words + pick("", "mail ", "contact ")
            if not y:
                match, left = f"{text(low, 3)}(at){text(low, 2)}.{text(low, 2)}", words + pick("", "look ")
        else:
            if y:
                match, left = pick((text(hexa, int(pick(18, 32, 40))), words + pick("password=", 'token = "', "secret: ", "api_key=", "auth token=")), ("AKIA" + text("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), words))
                if rng.integers(3) == 0:  # longer than most: platform tokens, keys in base 64, segments of web tokens
                    long = lambda *ks: text(low + low.upper() + digits, int(pick(*ks)))
                    match = pick("ghp_" + long(36), "github_pat_" + long(22) + "_" + long(59), long(64, 88, 171, 344) + "/" + long(20), "eyJ" + long(90, 160, 300))
                match = match if any(c.isdigit() for c in match) else match[:-1] + "7"
            elif rng.integers(3) == 0:
                match = pick(text(hexa, int(pick(64, 96, 128))), "-".join(text(low, int(k)) for k in rng.integers(3, 10, 15)) + text(digits, 3), "/" + "/".join(text(low, int(k)) for k in rng.integers(3, 12, 12)) + text(digits, 2))
                left = words + pick("", "commit ", "id ", "part ", "see ")
                match = match if any(c.isdigit() for c in match) else match[:-1] + "7"
            else:
                match = pick(text(low, 9) + "-" + text(digits, 4) + "-" + text(low, 5), text(digits, int(rng.integers(16, 20))), text(hexa, int(pick(16, 32, 40))), text(low, 14) + text(digits, 3), "/" + text(low, 7) + "/" + text(low, 6) + text(digits, 2) + "/" + text(low, 4))
                left = words + pick("", "commit ", "id ", "part ")
                match = match if any(c.isdigit() for c in match) else match[:-1] + "7"
        rows.append(features_of(kind, match, left[-CONTEXT:]))
        labels.append(y)
    return np.array(rows, dtype=float), np.array(labels, dtype=float)


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple
    thresholds: tuple  # on the margin, one per kind

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(t.predict(x) for t in self.trees)


@lru_cache
def trained(n: int = 4000, seed: int = 11) -> Model:
    """The model from ``n`` generated candidates; each kind's threshold from its own among as many
    held-out ones.  A kind whose candidates never reach the precision proposes nothing."""
    x, y = generate_candidates(n, seed)
    start, trees = boost(x, y)
    model = Model(start, tuple(trees), ())
    hx, hy = generate_candidates(n, seed + 1)
    m = model.margin(hx)

    def threshold(kind: int) -> float:
        own = hx[:, 0] == kind
        cuts = np.unique(np.floor(m[own] * 1000) / 1000)
        return next((float(c) for c in cuts if hy[own & (m >= c)].mean() >= PRECISION), float("inf"))

    return Model(start, tuple(trees), tuple(map(threshold, range(len(KINDS)))))


# --- spans ------------------------------------------------------------------------------------
BLOCK = 128  # appending to an array copies it, so running values are made in blocks
PAGE = 4096  # code points of a text that one substring looks through


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; inside array functions Spark would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _most(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def _scan(steps: Column, first: Column, join) -> Column:
    """What ``join`` has made of ``first`` and the elements before each one."""
    empty = F.array().cast("array<bigint>")
    state = F.struct(first.cast("bigint").alias("at"), empty.alias("out"))
    return F.aggregate(steps, state, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _running(steps: Column, first: Column, join) -> Column:
    """``_scan`` in two levels, for arrays of any length; ``join`` takes 0 as nothing."""

    def blocks(s: Column) -> Column:
        last = F.greatest(F.ceil(F.size(s) / BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK)))

    def over(bs: Column) -> Column:
        whole = F.transform(bs, lambda s: F.aggregate(s, F.lit(0).cast("bigint"), join))
        return F.flatten(F.zip_with(bs, _scan(whole, first, join), lambda s, f: _scan(s, f, join)))

    return _let(steps, lambda s: _let(blocks(s), over))


def _starts(gaps: Column, lengths: Column) -> Column:
    """Start of each match: all gaps up to its own plus all earlier matches."""

    def made(v: Column) -> Column:
        steps = F.transform(v["n"], lambda x, i: (F.get(v["g"], i + 1) + x).cast("bigint"))  # to the next start
        return _running(steps, F.get(v["g"], F.lit(0)), lambda a, x: a + x)

    return _let(F.struct(gaps.alias("g"), lengths.alias("n")), made)


def _lefts(pieces: Column, matches: Column) -> Column:
    """The ``CONTEXT`` code points before each match, from the pieces and matches ahead of it: three are long enough."""

    def left(v: Column, i: Column) -> Column:
        parts = [F.right(F.get(v["p"], i), F.lit(CONTEXT))]
        for k in (1, 2, 3):
            ahead = F.when(i >= k, F.concat(F.right(F.get(v["p"], F.greatest(i - k, F.lit(0))), F.lit(CONTEXT)), F.right(F.get(v["m"], F.greatest(i - k, F.lit(0))), F.lit(CONTEXT))))
            parts.insert(0, F.coalesce(ahead, F.lit("")))
        return F.right(F.concat(*parts), F.lit(CONTEXT))

    return _let(F.struct(pieces.alias("p"), matches.alias("m")), lambda v: F.transform(v["m"], lambda _, i: left(v, i)))


def find(text: str, pattern: str, kind: str, when: Column, name: str, df: DataFrame, *, context: bool = False) -> DataFrame:
    """Add ``name``: array of (start, stop, kind, match) of all matches, empty where ``when`` fails; with ``context`` also what stands left of them."""
    t, none = F.col(text), F.array().cast("array<string>")
    df = df.withColumns({f"{name}_m": F.when(when, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)})
    any_match = F.size(f"{name}_m") > 0
    df = df.withColumn(f"{name}_g", F.when(any_match, F.split(t, pattern, -1)))
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    df = df.withColumn(f"{name}_s", F.when(any_match, _starts(lengths(f"{name}_g"), lengths(f"{name}_m"))))
    fields = "start:bigint,stop:bigint,kind:string,match:string" + ",left:string" * context
    spans = F.zip_with(f"{name}_m", f"{name}_s", lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("stop"), F.lit(kind).alias("kind"), m.alias("match")))
    if context:
        spans = F.zip_with(spans, _lefts(F.col(f"{name}_g"), F.col(f"{name}_m")), lambda x, left: F.struct(*(x[c].alias(c) for c in ("start", "stop", "kind", "match")), left.alias("left")))
    return df.withColumn(name, F.when(any_match, spans).otherwise(F.array().cast(f"array<struct<{fields}>>"))).drop(*(f"{name}_{x}" for x in "mgs"))


def _outside(candidates: Column, base: Column) -> Column:
    """Candidates that no base span contains, from one pass in the order of starts with the furthest stop so far."""

    def merged(v: Column) -> Column:
        of_base = F.transform(v["b"], lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("own"), x["stop"].alias("stop"), F.get(v["c"], F.lit(-1)).alias("x")))
        own = F.transform(v["c"], lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("own"), x["stop"].alias("stop"), x.alias("x")))
        return F.array_sort(F.concat(of_base, own))

    def judged(ms: Column) -> Column:
        reach = _running(F.transform(ms, lambda m: F.when(m["own"] == 0, m["stop"]).otherwise(0).cast("bigint")), F.lit(0), _most)
        both = F.zip_with(ms, reach, lambda m, r: F.struct(m.alias("m"), r.alias("r")))
        return F.transform(F.filter(both, lambda s: (s["m"]["own"] == 1) & (s["r"] < s["m"]["stop"])), lambda s: s["m"]["x"])

    free = _let(_let(F.struct(candidates.alias("c"), base.alias("b")), merged), judged)
    return F.when((F.size(candidates) > 0) & (F.size(base) > 0), free).otherwise(candidates)


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, LONGEST) & luhn(F.when(F.length(digits) <= LONGEST, digits).otherwise("0"))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda x: _passes(kind, x["match"])


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _in_order(spans: Column) -> Column:
    """Sorted by start, then kind as listed, then end."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), _rank(x["kind"]).alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    return F.sort_array(keyed)


def with_spans(docs: DataFrame, *, text: str = "text", model: Model | None = None) -> DataFrame:
    """Add _pii_base and _pii_all: sorted arrays of (start, rank, stop, kind)."""
    model = model or trained()
    df = docs.withColumn("_pii_t", F.coalesce(F.col(text), F.lit("")))
    t = F.col("_pii_t")
    df = df.withColumn("_pii_digits", t.rlike("[0-9]"))
    for kind, pattern in BASE.items():
        gate = F.contains(t, F.lit("@")) if kind == "email" else F.col("_pii_digits") & F.contains(t, F.lit(HINT[kind]))
        df = find("_pii_t", pattern, kind, gate, f"_pii_b_{kind}", df)
        df = df.withColumn(f"_pii_b_{kind}", F.filter(f"_pii_b_{kind}", _passing(kind)))
    base = [f"_pii_b_{k}" for k in BASE]
    df = df.withColumn("_pii_b", F.concat(*base))
    for kind, pattern in GENERATORS.items():
        gate = (F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("AT"))) if kind == "email" else F.col("_pii_digits")
        df = find("_pii_t", pattern, kind, gate, f"_pii_g_{kind}", df, context=True)
    proposed = [f"_pii_g_{k}" for k in GENERATORS]

    def chosen(x: Column) -> Column:
        features = feature_columns(x["kind"], x["match"], x["left"])

        def scored(f: Column) -> Column:
            score = F.lit(model.start)
            for tree in model.trees:
                score = score + tree.column({name: f[name] for name in features})
            return score

        least = F.lit(float("inf"))
        for kind, threshold in zip(KINDS, model.thresholds):
            least = F.when(x["kind"] == kind, F.lit(threshold)).otherwise(least)
        return _let(F.struct(*(c.alias(name) for name, c in features.items())), scored) >= least

    df = df.withColumn("_pii_g", F.concat(*proposed))
    df = df.withColumn("_pii_f", _outside(F.col("_pii_g"), F.col("_pii_b")))
    chosen_spans = F.transform(F.filter("_pii_f", chosen), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "stop", "kind", "match"))))
    df = df.withColumn("_pii_x", chosen_spans)
    df = df.withColumn("_pii_base", _in_order(F.col("_pii_b"))).withColumn("_pii_all", _in_order(F.concat("_pii_b", "_pii_x")))
    return df.drop("_pii_digits", "_pii_b", "_pii_g", "_pii_f", "_pii_x", *base, *proposed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, base counts, base_sha256, spans, and how many spans and credentials there are in all."""
    df = with_spans(docs.select(F.col(key), F.col(text)), text=text, model=model)
    counts = [F.size(F.filter("_pii_base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select(key, *counts, F.sha2(_joined(F.col("_pii_base")), 256).alias("base_sha256"), _joined(F.col("_pii_all")).alias("spans"), F.size("_pii_all").cast("long").alias("n_spans"), F.size(F.filter("_pii_all", _of_kind("secret"))).cast("long").alias("n_secret"))


def _between(pages: Column, start: Column, stop: Column) -> Column:
    """Code points from ``start`` to ``stop`` of a text given as pages of ``PAGE``; only pages in between are copied."""
    first, last = F.floor(start / PAGE).cast("int"), F.floor(stop / PAGE).cast("int")
    within, upto = (start % PAGE).cast("int"), (stop % PAGE).cast("int")
    page = lambda k: F.coalesce(F.get(pages, k), F.lit(""))
    inner = F.array_join(F.slice(pages, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    long = F.concat(page(first).substr(within + 1, F.lit(PAGE)), inner, page(last).substr(F.lit(1), upto))
    return F.when(first == last, page(first).substr(within + 1, F.greatest(stop - start, F.lit(0)).cast("int"))).otherwise(long)


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by the kind of its first."""

    def made(v: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            mark = lambda at: F.when(x["start"] >= at, F.concat(_between(v["pages"], at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
            return _let(F.get(v["reach"], i), mark)

        tail = _between(v["pages"], F.array_max(F.transform(v["spans"], lambda x: x["stop"])), v["n"])
        return F.concat(F.array_join(F.transform(v["spans"], piece), ""), tail)

    reach = lambda s: _running(F.transform(s, lambda x: x["stop"].cast("bigint")), F.lit(0), _most)
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    return _let(spans, lambda s: _let(F.struct(s.alias("spans"), reach(s).alias("reach"), pages.alias("pages"), F.length(text).cast("bigint").alias("n")), made))


def redact(docs: DataFrame, *, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlaps become one."""
    df = with_spans(docs, text=text, model=model)
    whole = _redacted(F.col("_pii_t"), F.col("_pii_all"))
    return df.withColumn(text, F.when(F.size("_pii_all") > 0, whole).otherwise(F.col(text))).drop("_pii_t", "_pii_base", "_pii_all")
