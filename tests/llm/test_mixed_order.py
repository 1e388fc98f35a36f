"""The mix reaches the pipeline's result, and any number of sources can be mixed."""

import corpus_pipeline

from banderole.llm import mixing


def test_result_sorted_by_its_place_meets_the_weights(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 10 < 7 else f"s{i % 3}", 6) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    out = sorted(corpus_pipeline.encode_pieces(spark, mixed.repartition(5), "").collect(), key=lambda r: (r["mix_slot"], r["mix_rank"]))
    assert [r["doc_id"] for r in out] == [r["doc_id"] for r in mixed.collect()]
    counts = {s: sum(r[3] == s for r in rows) for s in ("hot", "s0", "s1", "s2")}
    target = mixing.tempered(counts)
    first = [r["source"] for r in out[:1000]]
    for s, w in target.items():
        assert abs(first.count(s) - 1000 * w / sum(target.values())) <= 16 + 2


def test_more_sources_than_a_phase_schedule_holds(spark):
    rows = [(i, f"s{i % 900}" if i % 3 else "hot") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mix(df, block_rows=4).collect()
    assert sorted((r["doc_id"], r["source"]) for r in out) == rows
    slots = {}
    for r in out:
        assert r["_mix_block"] == r["_mix_rank"] // 4
        slots.setdefault(r["_mix_slot"], set()).add((r["source"], r["_mix_block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
