"""What every operator must survive: large ids next to nulls, clashing names, empty tables, long texts."""

import heapq
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from banderole.llm import chat, html_crf, mixing, near_copies, pii, simhash, sp_suffix, tiff, token_store, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BIG = (1 << 53) + 1
IDS = [BIG, None, BIG + 2, -BIG - 2]


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([(i, f"some text number {i} with words") for i in IDS], "doc_id long, text string").coalesce(1)


def keys(df, name="key"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is not None, x or 0))


WANT = sorted(IDS, key=lambda x: (x is not None, x or 0))


def test_large_ids_stay_whole_next_to_nulls(spark, few):
    pieces, bytes_ = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    assert keys(simhash.fingerprints(few)) == WANT
    assert keys(simhash.near_duplicates(few)) == WANT
    assert keys(near_copies.near_copies(few)) == WANT
    assert keys(sp_suffix.digest(few, pieces)) == WANT
    assert keys(sp_suffix.encode(few, pieces), "doc_id") == WANT
    assert keys(token_store.tokenise_and_index(few, bytes_)) == WANT
    assert keys(tiff.store_payloads(few)) == WANT
    assert keys(tiff.tiff_pages(tiff.encode_payloads(few).withColumnRenamed("key", "doc_id"))) == WANT
    turns = few.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert keys(chat.read_back(chat.format_conversations(turns)), "conv_id") == WANT
    assert keys(pii.report(few), "doc_id") == WANT


def test_columns_that_have_a_results_name_are_replaced(spark, few):
    labels = spark.createDataFrame([(BIG, 1)], "doc_id long, toxic int")
    scored = toxicity.score(few.withColumn("Score", F.lit("x")), toxicity.fit(few, labels))
    assert scored.columns == ["doc_id", "text", "score"] and all(0 <= r["score"] <= 1 for r in scored.collect())
    encoded = sp_suffix.encode(few.withColumn("ids", F.lit(1)), public_tokenizers.path("piece_bpe_32k.model"))
    assert encoded.columns == ["doc_id", "text", "ids"] and all(len(r["ids"]) > 3 for r in encoded.collect())
    pages = few.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("text"), F.lit("<p>x").alias("html"), F.lit(1).alias("n_chars"), F.lit(2).alias("other"))
    assert sorted(html_crf.extract(pages).columns) == ["n_chars", "other", "page_id", "text"] and html_crf.extract(pages).count() == 4
    clash = few.select("doc_id", F.lit("s").alias("source"), *(F.lit(7).alias(c) for c in ("start", "s", "b", "q", "b0", "b1", "slots", "count", "_mix_rank")))
    assert sorted(r["_mix_rank"] for r in mixing.mix(clash).collect()) == [0, 1, 2, 3]
    assert {r["start"] for r in mixing.mix(clash).collect()} == {7}
    assert keys(pii.redact(few.withColumn("match", F.lit(1)).withColumn("kind", F.lit(2))), "doc_id") == WANT


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.fit(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(none, model).count() == 0
    assert html_crf.extract(none.withColumnRenamed("text", "html")).count() == 0
    assert near_copies.near_copies(none).count() == 0
    assert tiff.tiff_pages(tiff.encode_payloads(none).withColumnRenamed("key", "doc_id")).count() == 0


def test_one_id_or_none_on_many_rows_spreads_over_buckets(spark):
    rows = [(None, "hot", i) for i in range(3000)] + [(5, "hot", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, x int")
    out = mixing.mix(df, bucket_rows=500).collect()
    assert sorted(r["_mix_rank"] for r in out) == list(range(6000))
    early = [r["doc_id"] is None for r in sorted(out, key=lambda r: r["_mix_rank"])[:1000]]
    assert 400 < sum(early) < 600  # in hash order of the rows, not id after id


def test_scores_equal_a_plain_mean_of_word_vectors():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.standard_normal(1 << 10).astype(np.float32), -0.3)
    texts = ["", "Plain words, and (marks)!", "日本語 é 🎉 x", "aaaa aaaa ababab", "w" * 300 + "é" * 100, "a-b " * 50]

    def value(word):
        w = word[1:] if word[:1] == " " else "<" + word.strip(toxicity.STRIP) + ">"
        grams = {w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)} | {w}
        return np.mean([model.values[zlib.crc32(g.encode()) % 1024] for g in grams])

    want = [1 / (1 + np.exp(-((np.mean([value(w) for w in toxicity.text_words(t)]) if t.split() else 0) - 0.3))) for t in texts]
    assert np.allclose(toxicity.Scorer(model).scores(texts), want, atol=1e-6)


def test_long_labelled_texts_train(spark):
    rows = [(i, ("zgrux " if i % 2 else "mild ") * 4000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r["score"] >= 0.7) == bool(r["doc_id"] % 2) for r in out)


def test_trees_and_features_in_sql_equal_the_numpy_ones(spark):
    model = pii.trained()
    rng = np.random.default_rng(8)
    left = ["", "password=", 'token = "', "call ", "x" * 24, "card: ", "mail "]
    match = ["ghp_0123456789abcdefABCDEF0123456789abcd", "4111 1111 1111 1111", "020-7946-0018", "bob (at) mail.example", "9" * 40, "A1" * 60, "/" * 20 + "7"]
    rows = [(pii.KINDS[int(rng.integers(5))], m, x) for m in match for x in left]
    df = spark.createDataFrame(rows, "kind string, match string, before string")
    features = pii.feature_columns(F.col("kind"), F.col("match"), F.col("before"))
    score = F.lit(model.start)
    for t in model.trees:
        score = score + t.column(features)
    got = df.select("kind", "match", "before", *(features[f].cast("double").alias(f"f_{f}") for f in pii.FEATURES), score.alias("margin")).collect()
    for r in got:
        want = pii.features_of(r["kind"], r["match"], r["before"])
        assert [r[f"f_{f}"] for f in pii.FEATURES] == want
        assert abs(r["margin"] - model.margin(np.array([want]))[0]) < 1e-9


def test_very_long_runs_of_personal_data(spark):
    rows = [(1, "a@b" + ".c" * 100_000), (2, "bob (at) mail" + " (dot) x" * 20_000), (3, "4 " * 100_000), (4, "+1" * 100_000), (5, "a" * 200_000 + "1"), (6, "x@" * 50_000), (7, "1" * 200_000)]
    out = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["spans"] == "email:0:200003" and out[1]["n_email"] == 1
    assert all(out[i]["n_email"] == 0 for i in range(2, 8))


def test_redaction_of_every_kind_of_candidate(spark):
    text = 'Write to jo (at) mail (dot) example (dot) org or call (555) 010-4477. token = "ghp_' + "a1B2" * 9 + '" order 1234-5678-99'
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert "ghp_" not in out and "[SECRET]" in out and "jo (at)" not in out
    assert "1234-5678-99" in out


@pytest.mark.parametrize("field, value", [(256, 0), (257, 0), (257, 1 << 31), (256, 0xFFFFFFFF), (277, 0), (278, 0)])
def test_tiff_with_impossible_sides_gives_an_error_row(spark, field, value):
    page = np.arange(64 * 3 * 5, dtype=np.uint8).reshape(5, 64, 3)
    raw = bytearray(tiff.encode_tiff([page, page], tiff.Layout(tiff.DEFLATE)))
    (at,) = np.frombuffer(raw[4:8], "<u4")
    n = int.from_bytes(raw[at : at + 2], "little")
    second = int.from_bytes(raw[at + 2 + 12 * n : at + 6 + 12 * n], "little")
    for i in range(n):
        entry = second + 2 + 12 * i
        if int.from_bytes(raw[entry : entry + 2], "little") == field:
            raw[entry + 2 : entry + 12] = (4).to_bytes(2, "little") + (1).to_bytes(4, "little") + value.to_bytes(4, "little")
    rows = tiff.tiff_pages(spark.createDataFrame([(1, raw)], "doc_id long, media binary")).collect()
    assert [r["error"] is None for r in rows] == [True, False] and rows[0]["samples"] == page.tobytes()


def test_every_layout_serves_long_and_short_payloads():
    chosen = {size: {tiff.layout_for(tiff.payload_of(f"{i} " * size)[0]) for i in range(200)} for size in (2, 3000)}
    assert chosen[2] == chosen[3000] == set(tiff.LAYOUTS)


def test_deep_nesting_keeps_the_article():
    page = "<div class=article>" * 20_000 + "<p>deep text here, and more of it.</p>" + "</div>" * 20_000
    assert html_crf.main_text(page, html_crf.trained()) == "deep text here, and more of it."


def test_viterbi_equals_the_best_of_all_labellings():
    field = html_crf.trained()
    page, _ = html_crf.labelled_page(np.random.default_rng(123))
    blocks = html_crf.leaf_blocks(page)[:12]
    scored = []
    for code in range(1 << len(blocks)):
        labels = [code >> k & 1 for k in range(len(blocks))]
        total = field.starts[labels[0]] + sum(field.emission(b)[y] for b, y in zip(blocks, labels)) + sum(field.moves[a][b] for a, b in zip(labels, labels[1:]))
        scored.append((total, labels))
    best = heapq.nlargest(1, scored)[0]
    got = field.viterbi(blocks)
    assert abs(best[0] - next(s for s, x in scored if x == got)) < 1e-9


def test_other_models_than_bpe_are_refused(tmp_path):
    with pytest.raises(Exception):
        sp_suffix.Encoder(str(tmp_path / "missing.model"))
    enc = sp_suffix.Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    enc.pieces.ids = enc.pieces.ids[::-1]  # a vocabulary that doesn't fit the library's
    with pytest.raises(ValueError):
        enc.known, enc.older = {}, {}
        enc._check(public_tokenizers.path("piece_bpe_32k.model"))


def test_byte_pieces_equal_the_library_on_awkward_white_space():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, enc, rng = Tokenizer.from_file(path), token_store.WordEncoder(path), np.random.default_rng(3)
    assert enc.cuts
    parts = [" ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "　", "a", "b1", "é", "'s", "<|endoftext|>", "\0", "日本", "🎉", "!!", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(5000)]
    for t, raw, e in zip(texts, enc.encode(texts, 0), library.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(raw, "<u2").tolist() == [*e.ids, 0], repr(t)
