"""Releases are whole or absent; owners keep what is theirs."""

import pytest

from banderole.sinks import owned
from banderole.sinks.releases import Refused, Releases, digest
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    return Releases(spark, f"file://{tmp_path}/r")


def broken(spark):
    return spark.range(10, numPartitions=2).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))


def test_failure_between_two_tables_leaves_the_release_before(spark, store):
    assert store.versions() == [] and store.manifests().count() == 0 and store.baseline() is None
    assert store.publish({"a": spark.range(5), "b": spark.range(3)}) == 1
    with pytest.raises(Exception, match="lost"):
        store.publish({"a": spark.range(50), "b": broken(spark)})
    with pytest.raises(Refused, match="b: 0 rows"):
        store.publish({"a": spark.range(50), "b": spark.range(0)})
    assert store.versions() == [1] and store.read("a").count() == 5 and store.read("b").count() == 3
    assert store.sweep() == 0  # young enough to belong to a running writer
    assert store.sweep(older_than=0) == 2 and store.read("a").count() == 5
    assert store.publish({"a": spark.range(50)}) == 2
    assert store.read("a", 1).count() == 5 and store.read("b", 1).count() == 3
    with pytest.raises(KeyError):
        store.read("b")
    with pytest.raises(Refused):
        store.publish({})


def test_a_manifest_that_isnt_in_place_isnt_read(spark, store, monkeypatch):
    store.publish({"a": spark.range(5)})
    monkeypatch.setattr(Releases, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        store.publish({"a": spark.range(6)})
    monkeypatch.undo()
    assert store.read("a").count() == 5
    assert store.publish({"a": spark.range(7)}) == 3  # the number of the lost run stays claimed
    assert [r["version"] for r in store.history().orderBy("version").collect()] == [1, 3]


def test_the_same_rows_arent_published_twice(spark, store):
    df = spark.range(100).select("id", F.create_map(F.lit("k"), F.col("id")).alias("m"), F.when(F.col("id") > 5, "x").alias("n"))
    assert store.publish({"a": df.repartition(3)}) == 1
    assert store.publish({"a": df.orderBy(F.desc("id")).coalesce(1)}) is None
    assert store.publish({"a": df.unionByName(df.where("id = 1"))}) == 2
    got = {r["version"]: (r["rows_before"], r["rows"], r["changed"]) for r in store.history().collect()}
    assert got == {1: (None, 100, True), 2: (100, 101, True)}


def test_two_writers_get_two_numbers(spark, store):
    other = Releases(spark, store.root, writer="other")
    assert store._claim() == 1 and other._claim() == 2
    assert store.publish({"a": spark.range(1)}) == 3


def test_history_is_capped_and_shows_what_was_added(spark, store):
    for n in range(1, 5):
        store.publish({"a": spark.range(n)})
    assert sorted(r["version"] for r in store.history(most=2).collect()) == [3, 4]
    assert [r[0] for r in store.added("a", "id").collect()] == [3] and store.added("a", "id", 1).count() == 0


def test_promotion_needs_passed_gates(spark, store):
    store.publish({"a": spark.range(1)})
    failing = spark.createDataFrame([("rows fell",)], "gate string")
    with pytest.raises(Refused, match="rows fell"):
        store.promote(1, failing)
    assert store.baseline() is None
    store.promote(1, failing.where("false"))
    store.publish({"a": spark.range(2)})
    store.promote(2)
    assert store.baseline() == 2
    with pytest.raises(KeyError):
        store.promote(9)


def test_digest_tells_nulls_columns_and_repeats_apart(spark):
    of = lambda rows, ddl="a string, b string": digest(spark.createDataFrame(rows, ddl)).first()["digest"]
    assert len({of([("x", None)]), of([(None, "x")]), of([("x", "null")]), of([("x", None)] * 2), of([])}) == 5
    assert of([("1", "2"), ("3", "4")]) == of([("3", "4"), ("1", "2")])


def test_owners(spark):
    sha = lambda b: __import__("hashlib").sha256(b.encode()).hexdigest()
    store = spark.createDataFrame([("mine", "old", "me", sha("old")), ("edited", "works", "me", sha("old")), ("theirs", "works", "you", sha("works")), ("rotten", "", "you", sha("")), ("void", None, None, None)], "key string, body string, owner string, sha256 string")
    new = spark.createDataFrame([(k, "new") for k in ("mine", "edited", "theirs", "rotten", "fresh", None)] + [("fresh", "a")], "key string, body string")
    works = F.length("body") > 0
    got = {r["key"]: r["outcome"] for r in owned.merged(store, new, "me", works).collect()}
    assert got == {"mine": "replaced", "edited": "refused", "theirs": "refused", "rotten": "replaced", "void": "kept", "fresh": "added"}
    after = owned.emit(store, new, "me", works)
    assert {r["key"]: (r["body"], r["owner"]) for r in after.collect()}["fresh"] == ("a", "me")
    left = owned.withdraw(after, spark.createDataFrame([("fresh",), ("theirs",), ("mine",), ("nowhere",)], "key string"), "me")
    assert {r["key"] for r in left.collect()} == {"edited", "theirs", "rotten", "void"}
