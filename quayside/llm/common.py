"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of these operators define it.
WHITE = r"\x20\x09-\x0D"


def named(column: str) -> Column:
    """A column by its whole name, which may hold dots and backticks."""
    return F.col(f"`{column.replace('`', '``')}`")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent, a single-machine session gets a fresh temporary
    folder, which the session remembers; on a cluster that is an error, as
    executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quayside.local.folder", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quayside-")
        spark.conf.set("quayside.local.folder", root)
    return root


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read of replicated files, not a re-run of
    everything above, and both uses of a twice-used result see the same rows.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders written by this process and not removed yet.
_written: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


def forget(spark: SparkSession, since: int = 0) -> None:
    """Remove what operators have written, from the ``since``-th folder on; results that read it must have been written elsewhere by then."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def written_so_far() -> int:
    """How many folders operators have written and not removed yet."""
    return len(_written)


def tokenizer_path() -> str:
    """The byte-level BPE file: ``CORPUS_TOKENIZER``, or the one of the installed public tokenizers."""
    import public_tokenizers

    return os.environ.get("CORPUS_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")
