"""Near copies of the pipeline's stage against all pairs in plain Python."""

import random

import corpus_pipeline

from banderole.llm import near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted():
    rng, texts = random.Random(3), []
    for _ in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):
            copy = list(words)
            for i in rng.sample(range(len(copy)), edits):
                copy[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_stage_drops_planted_near_copies(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_copies(spark, docs, "").select("doc_id").collect())
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8]
    assert len(alike) > 100
    group = list(range(len(texts)))
    for _ in texts:
        for i, j in alike:
            group[i] = group[j] = min(group[i], group[j])
    assert not [p for p in alike if set(p) <= set(kept)]
    assert set(kept) >= {i for i, g in enumerate(group) if i == g}


def test_a_group_gives_one_pair_a_member_and_edge_rows_stay(spark):
    base = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(50)] + [(90, ""), (91, None), (92, "A b"), (93, "a B"), (None, "a b"), (94, "c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near_copies.one_of_each_group(docs).select("doc_id").collect())
    assert out == [(False, 0), (False, 90), (False, 92), (False, 94), (True, 0)]
    first = docs.where("doc_id < 50")
    met = near_copies.marks(first, key="doc_id", text="text", shingle=5, bands=20, rows=4).selectExpr("cls as key", "sig", "posexplode(bands) as (at, band)")
    met = met.join(near_copies.shingle_sets(first, text="text", shingle=5, sketch=True), "key").selectExpr("*", "key as group", "cast(null as array<long>) failed")
    assert near_copies.candidates(met, 4, 1).count() < 150
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_groups_equal_the_components_of_all_pairs(spark):
    """A large group whose members resemble each other at 0.3 to 1: whole, though not all pairs are compared."""
    rng, base = random.Random(9), [f"w{i}" for i in range(150)]
    texts = planted()[:120]
    for k in range(160):
        words = list(base)
        for i in rng.sample(range(150), k % 14):
            words[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    group = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["key"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == group


def test_a_repeated_id_keeps_each_texts_group(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, "something else altogether in here"), (2, long + " more"), (None, long), (3, "yet another text that is alone here")]
    out = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["key"] or 0, r["component_id"]) for r in out) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
