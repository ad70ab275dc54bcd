"""Results that are used twice, written once to the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a fresh temporary folder on one machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quayside.local.folder", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quayside-")
        spark.conf.set("quayside.local.folder", root)
    return root


#: Folders written by this process and not removed yet.
_made: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from files of its own: a lost executor costs a re-read, and every use sees the same rows."""
    path = os.path.join(folder(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """How many folders operators have written and not removed yet."""
    return len(_made)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Remove what operators have written, from the ``since``-th folder on; results that read it must have been written elsewhere by then."""
    while len(_made) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
