"""Tables written to the folder that the driver and all executors share.

Iterative and multi-pass operators cut lineage here: the written files survive lost executors,
carry real statistics for the optimizer and are read again as plain Parquet.  What later steps have
made needless is deleted at once (``discard``), the rest when the driver's process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder of its own, removed at exit;
    on a cluster a missing setting is an error, because a machine-local folder would lose files.
    """
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="banderole-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path that no other run uses; what is written there is deleted when the process ends."""
    if not _made:
        atexit.register(lambda: discard(*_made))
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(*paths: str) -> None:
    """Delete tables that nothing will read again."""
    from pyarrow import fs

    for path in paths:
        try:
            files, at = fs.FileSystem.from_uri(path)
            if files.get_file_info(at).type == fs.FileType.Directory:
                files.delete_dir(at)
        except (OSError, ValueError):  # a folder on a file system that only Spark can reach stays
            continue


def paths_since(mark: int) -> list[str]:
    return _made[mark:]


def mark() -> int:
    """A point in the list of tables made, for ``paths_since``."""
    return len(_made)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back."""
    return written(df, label)[0]


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``materialise``, and the path for ``discard``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
