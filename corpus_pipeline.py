"""A training-corpus pipeline: five stages over the documents table, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.

Edge cases: null texts are empty to every stage and stay null in the result's place of it (its ids
are empty); rows without an id are never copies of an earlier document and stay; a null source is
the source with the empty name; repeated rows of one id stay or go together; an empty table gives no
rows; columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banderole.llm import mixing, near_copies, pii, sp_suffix, toxicity
from banderole.llm.queries import TOXIC_AT, toxicity_model
from banderole.llm.store import discard, mark, paths_since, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; labels that aren't held out train it."""
    scored = toxicity.score(docs.select(*COLUMNS), toxicity_model(spark, sf_dir, docs))
    return scored.where(F.col("score") < TOXIC_AT).select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: five-word Jaccard of 0.8 or more.

    SimHash fingerprints and their vantage-point tree link what lies near, minimum hashes the rest; exact sets decide.
    """
    return near_copies.one_of_each_group(docs, shingle=5, percent=80).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair mix, over files and within them."""
    return mixing.in_mixed_order(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the SentencePiece ids of their texts and their place in the mix.

    Files don't keep an order, so the place is a result: sorting by (mix_slot, mix_rank) gives the
    order of ``mix_sources``, which follows from ids and sources alone.
    """
    import public_tokenizers

    mixed = mixing.mix(docs.select(*COLUMNS))
    placed = mixed.select(*COLUMNS, F.col("_mix_slot").alias("mix_slot"), F.col("_mix_rank").alias("mix_rank"))
    encoded = sp_suffix.encode(placed, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.withColumn("n_ids", F.size("ids").cast("long")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to the shared folder and reread.

    What a stage has made on its way is deleted as soon as its result is written.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        since = mark()
        docs, result = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*(p for p in (path, *paths_since(since)) if p and p != result))
        path = result
    return docs
