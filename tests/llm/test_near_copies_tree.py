"""Near copies by the SimHash tree and settled meetings: rows grow with members, none is missed."""

import random

from pyspark.sql import functions as F

from banderole.llm import near_copies

WAYS = {"shingle": 5, "bands": 20, "rows": 4}


def one_edit_each(n, words=74, seed=5):
    """Copies of one text, an edited word in each: any two have a similarity of about 0.75 and don't link."""
    rng, base, out = random.Random(seed), [f"w{i}" for i in range(words)], []
    for k in range(n):
        copy = list(base)
        copy[5 + k % (words - 10)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def groups_of(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def met_of(docs):
    sets = near_copies.shingle_sets(docs, text="text", shingle=5)
    met = near_copies.marks(docs, key="doc_id", text="text", **WAYS).selectExpr("cls as key", "sig", "posexplode(bands) as (at, band)")
    return met.withColumn("group", F.col("key")), sets


def test_a_group_that_does_not_link_gives_no_pair_of_each_two(spark):
    texts = one_edit_each(120, words=96)  # 0.8 is out of reach of pairs whose edits lie apart
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, sets = met_of(docs)
    now = met.join(sets.select("key", "sketch"), "key")
    alike = near_copies.candidates(now, 4, 1)
    assert alike.groupBy("u").agg(F.min("v")).count() < 120  # a pair for every look before: some thousand
    assert alike.count() <= met.count()
    assert near_copies.settle(met, sets, 4, 80).count() <= met.count()


def test_groups_are_whole_where_members_do_not_all_link(spark):
    texts = one_edit_each(90) + one_edit_each(40, words=110, seed=6) + ["A lone text of a few words", "", "a LONE text of a few words"]
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == groups_of(texts)


def test_only_a_shared_band_counts_as_met(spark):
    """Signatures of a byte a minimum hash made 1 in 256 unshared bands look shared: such pairs were never compared."""
    texts = one_edit_each(90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = {r["key"]: r for r in near_copies.marks(docs, key="doc_id", text="text", **WAYS).collect()}
    for i in known:
        for j in range(i):
            a, b = known[i], known[j]
            n = near_copies.WIDE
            seem = [a["sig"][k * n : k * n + n] == b["sig"][k * n : k * n + n] for k in range(20)]
            assert seem == [x == y for x, y in zip(a["bands"], b["bands"])]


def test_a_meeting_in_parts_settles_as_in_one(spark):
    texts = one_edit_each(90, words=90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, sets = met_of(docs)

    def names(held):
        found = near_copies.connected_components(near_copies.settle(met, sets, 4, 80, held=held))
        return {(r["node"], r["component"]) for r in found.collect()}

    assert names(1 << 26) == names(20_000)


def test_the_tree_links_what_lies_near(spark):
    base = [f"w{i}" for i in range(3000)]
    texts = [" ".join(base[:-1] + [f"end{i}"]) for i in range(20)] + [" ".join(f"v{i}" for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = near_copies.marks(docs, key="doc_id", text="text", **WAYS)
    pairs = near_copies.tree_pairs(known.selectExpr("cls", "fp"), 3).collect()
    alone = known.where("key = 20").first()["cls"]
    assert 10 <= len(pairs) <= 40 and all(alone not in (p["u"], p["v"]) for p in pairs)
