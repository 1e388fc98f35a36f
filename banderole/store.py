"""Tables that several passes of one operator read, written once to the shared folder.

Iterative operators write each round and read it again: the plan stays as short as one round's, and files
survive lost executors.  What a later round has replaced is discarded at once, everything else when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session without one gets a temporary folder of its own."""
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="banderole-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


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


def new_path(spark: SparkSession, label: str) -> str:
    """A path that no other run uses; what is written there is deleted when the process ends."""
    if not _made:
        atexit.register(lambda: discard(*_made))
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, label: str = "once") -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read again, and its path for ``discard``."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def once(df: DataFrame) -> DataFrame:
    """``df`` written and read again, so that its readers don't compute it anew.

    For additive cubes and other tables far smaller than what they are made of.
    """
    return written(df)[0]
