"""Releases: several tables published at once, or not at all.

Two phases.  Every table is written to a folder of its own, read again and checked (rows, columns, a digest that doesn't depend on their order).  Only
when all have passed does one manifest, moved into place as a single file, name the folders; that move is the commit.  Readers ask the newest manifest, so a run
that fails between two tables, or a task or driver that is lost, leaves the release before it readable, and what it wrote is never named.

Numbers are claimed by creating a file that must not exist, so of two writers at once each gets its own.  A release with the same
digests as the newest one isn't published again.  All files go through Hadoop's file systems, so the folder may lie wherever Spark can write.

Edge cases: a table with fewer rows than ``least`` or an error in any table refuses the release (``Refused``, or the error itself); a table may be missing from a release, then
readers of it get an error; a release without tables is refused; columns of any type that Parquet keeps are fine, maps are digested by their sorted entries.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, run string, writer string, stats map<string,string>, tables array<struct<name:string,path:string,rows:long,digest:string,columns:string>>"
CHANGELOG = 60


class Refused(ValueError):
    """A release that isn't fit to be read."""


def _plain(c: Column, kind: T.DataType) -> Column:
    return F.to_json(F.struct(F.array_sort(F.map_entries(c)).alias("m"))) if isinstance(kind, T.MapType) else c


def digest(df: DataFrame) -> DataFrame:
    """One row of (rows, digest): the same for the same rows in any order and number of files; each row of several alike counts."""
    columns = [_plain(F.col(f"`{f.name}`"), f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    row = F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]
    sums = [F.sum(p.cast("decimal(38,0)")).alias(f"s{i}") for i, p in enumerate(parts)]
    return df.agg(F.count("*").alias("rows"), *sums).select("rows", F.sha2(F.concat_ws(",", "rows", *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4))), 256).alias("digest"))


class Releases:
    def __init__(self, spark: SparkSession, root: str, *, writer: str = "build"):
        self.spark, self.root, self.writer = spark, root.rstrip("/"), writer
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.root, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _put(self, body: str, *parts: str) -> None:
        """Write a small file beside its place and move it there."""
        aside, place = self._path("staging", uuid.uuid4().hex), self._path(*parts)
        out = self._fs.create(aside, True)
        out.write(bytearray(body.encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        if not self._fs.rename(aside, place):
            self._fs.delete(place, False)  # only pointers are ever replaced
            self._fs.rename(aside, place)

    def _claim(self) -> int:
        """A number that no other writer has, above all published ones."""
        version = max([0, *self.versions()]) + 1
        while True:
            try:
                self._fs.create(self._path("claims", str(version)), False).close()
                return version
            except Exception as e:  # py4j wraps Hadoop's FileAlreadyExistsException
                if "already exists" not in str(e):
                    raise
                version += 1

    def versions(self) -> list[int]:
        place = self._path("manifests")
        if not self._fs.exists(place):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(place) if s.getPath().getName().endswith(".json"))

    def manifests(self) -> DataFrame:
        """One row a release; empty without any."""
        if not self.versions():
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/*.json")

    def _manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        version = version or (known[-1] if known else None)
        if version is None:
            return None
        row = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/{version:010d}.json").first()
        return row.asDict(recursive=True)

    def publish(self, tables: dict[str, DataFrame], *, stats: dict[str, object] | None = None, least: int = 1) -> int | None:
        """The new release's number, or None if it holds what the newest one holds."""
        if not tables:
            raise Refused("no tables")
        run = uuid.uuid4().hex
        checked = []
        for name, df in tables.items():
            path = f"{self.root}/data/{run}/{name}"
            df.write.parquet(path)
            again = self.spark.read.schema(df.schema).parquet(path)  # what readers will see, not what was meant
            found = digest(again).first()
            if found["rows"] < least:
                raise Refused(f"{name}: {found['rows']} rows, {least} at least")
            checked.append({"name": name, "path": f"data/{run}/{name}", "rows": found["rows"], "digest": found["digest"], "columns": df.schema.simpleString()})
        last = self._manifest()
        same = lambda ts: sorted((t["name"], t["digest"], t["columns"]) for t in ts)
        if last and same(last["tables"]) == same(checked):
            self._fs.delete(self._path("data", run), True)
            return None
        version = self._claim()
        body = {"version": version, "run": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "writer": self.writer, "stats": {k: str(v) for k, v in (stats or {}).items()}, "tables": checked}
        self._put(json.dumps(body), "manifests", f"{version:010d}.json")
        return version

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a release, the newest one's by default."""
        manifest = self._manifest(version)
        at = next((t for t in (manifest or {"tables": []})["tables"] if t["name"] == table), None)
        if at is None:
            raise KeyError(f"no release has {table}" if version is None else f"release {version} has no {table}")
        return self.spark.read.parquet(f"{self.root}/{at['path']}")

    def history(self, *, most: int = CHANGELOG) -> DataFrame:
        """(version, run, table, rows_before, rows, changed) of the newest releases, the newest first in order of version."""
        each = self.manifests().select("version", "run", F.inline("tables"))
        before = Window.partitionBy("name").orderBy("version")
        changed = ~F.col("digest").eqNullSafe(F.lag("digest").over(before))
        rows = each.select("version", "run", F.col("name").alias("table"), F.lag("rows").over(before).alias("rows_before"), "rows", changed.alias("changed"))
        newest = self.versions()[-most:]
        return rows.where(F.col("version") >= (newest[0] if newest else 0))

    def added(self, table: str, column: str, version: int | None = None) -> DataFrame:
        """Values of a column that the release before didn't have; none for the first one."""
        known = self.versions()
        version = version or known[-1]
        earlier = [v for v in known if v < version]
        now = self.read(table, version).select(column).distinct()
        if not earlier:
            return now.where("false")
        return now.join(self.read(table, earlier[-1]).select(column).distinct().withColumnRenamed(column, "_was"), F.col(column).eqNullSafe(F.col("_was")), "left_anti")

    def promote(self, version: int, broken: DataFrame | None = None) -> None:
        """Make a release the one that later builds are compared with; ``broken``: gates that it fails, which must be none."""
        if version not in self.versions():
            raise KeyError(f"no release {version}")
        if broken is not None and (first := broken.first()) is not None:
            raise Refused(f"release {version} fails {first}")
        self._put(json.dumps({"version": version}), "baseline.json")

    def baseline(self) -> int | None:
        if not self._fs.exists(self._path("baseline.json")):
            return None
        return self.spark.read.schema("version long").json(f"{self.root}/baseline.json").first()[0]

    def sweep(self, *, older_than: float = 24 * 3600) -> int:
        """Delete data that no manifest names and that is old enough not to belong to a running writer; how many runs it was."""
        named = {r["path"].split("/")[1] for r in self.manifests().select(F.inline("tables")).select("path").distinct().collect()}
        gone = 0
        for place in ("data", "staging"):
            if self._fs.exists(self._path(place)):
                for s in self._fs.listStatus(self._path(place)):
                    if s.getPath().getName() not in named and time.time() - s.getModificationTime() / 1000 >= older_than:
                        gone += self._fs.delete(s.getPath(), True)
        return gone
