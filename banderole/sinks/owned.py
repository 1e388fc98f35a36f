"""Documents by owner: a writer adds and withdraws its own and never touches another's that works.

The store is a table of (key, body, owner, sha256); ``emit`` and ``withdraw`` give its next state as one join on the key,
for ``Releases.publish``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["key", "body", "owner", "sha256"]


def _digest(body: Column) -> Column:
    return F.sha2(F.coalesce(body.cast("binary"), F.lit(b"")), 256)


def merged(store: DataFrame, documents: DataFrame, owner: str, works: Column) -> DataFrame:
    """Store and new documents by key, with ``outcome``: kept, added, replaced or refused.

    A document is refused where another owner's stands and works (``works``: a condition over the store's ``body``), or where the body of its
    own owner was changed by somebody since (its digest no longer fits) and works.  Of new documents with one key the least body counts;
    those without a key are left out.
    """
    new = documents.where("key is not null").groupBy("key").agg(F.min("body").alias("new_body"))
    mine = (F.col("owner") == owner) & (F.col("sha256") == _digest(F.col("body")))
    held = F.col("owner").isNotNull() & ~mine & F.coalesce(works, F.lit(False))
    outcome = F.when(F.col("new_body").isNull(), "kept").when(F.col("owner").isNull(), "added").when(held, "refused").otherwise("replaced")
    return store.select(*COLUMNS).join(new, "key", "full").withColumn("outcome", outcome)


def emit(store: DataFrame, documents: DataFrame, owner: str, works: Column) -> DataFrame:
    """The store after the owner's documents went in where they may."""
    put = F.col("outcome").isin("added", "replaced")
    return merged(store, documents, owner, works).select(
        "key", F.when(put, F.col("new_body")).otherwise(F.col("body")).alias("body"), F.when(put, owner).otherwise(F.col("owner")).alias("owner"), F.when(put, _digest(F.col("new_body"))).otherwise(F.col("sha256")).alias("sha256")
    )


def withdraw(store: DataFrame, keys: DataFrame, owner: str) -> DataFrame:
    """The store without those of the keys that the owner put there."""
    asked = keys.select("key").distinct().withColumn("asked", F.lit(True))
    return store.join(asked, "key", "left").where(~(F.coalesce("asked", F.lit(False)) & F.col("owner").eqNullSafe(F.lit(owner)))).select(*COLUMNS)
