"""Bars stored by series, and upserts that tell what changed.

A store is a folder of Parquet files, one subfolder a day, each under the number
of the upsert that wrote it last.  An upsert reads the days that it touches,
writes them anew under its own number, and counts from the moment its small
catalogue file is renamed into place; what it replaces stays readable until then,
and for readers of an earlier number.  Stored rows are never shuffled: what comes
in is broadcast, in slices of a bounded number of rows.

Of several rows of one key in an upsert the one with the largest version counts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["inst", "minutes", "open_ns"]
VALUES = ["close_ns", "o", "h", "l", "c", "n"]
BAR = "inst bigint, minutes bigint, open_ns bigint, close_ns bigint, o bigint, h bigint, l bigint, c bigint, n bigint"
CHANGE = f"kind string, {BAR}"
DAY = 86_400_000_000_000
#: Incoming rows that are broadcast at once: a hundred bytes each.
SLICE = 200_000


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def catalogue(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """number: the last upsert that counts (or the given one); days: the upsert that wrote each day last."""
    fs, path = _path(spark, f"{folder}/catalogue")
    done = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    done = [n for n in done if n.endswith(".json") and (number is None or int(n[:-5]) <= number)]
    return json.loads(spark.read.text(f"{folder}/catalogue/{done[-1]}").first()[0]) if done else {"number": 0, "days": {}}


def bars(spark: SparkSession, folder: str, days: list[int] | None = None, number: int | None = None) -> DataFrame:
    """The stored bars, of some days or all, after the last upsert or that with ``number``."""
    held = catalogue(spark, folder, number)["days"]
    paths = [f"{folder}/data/{n}/day={d}" for d, n in held.items() if days is None or int(d) in days]
    return spark.read.schema(BAR).parquet(*paths) if paths else spark.createDataFrame([], BAR)


def commit(spark: SparkSession, folder: str, state: dict) -> None:
    """The switch: what was written under ``state['number']`` counts from now on."""
    fs, made = _path(spark, f"{folder}/catalogue/.{state['number']}.tmp")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    _, final = _path(spark, f"{folder}/catalogue/{state['number']:012d}.json")
    if not fs.rename(made, final):
        raise OSError(f"upsert {state['number']} was taken by another writer")


def _judged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with what an incoming row of the same key holds; ``new`` is broadcast, so stored rows stay where they are."""
    incoming = new.select(*[F.col(c).alias(f"__{c}") for c in KEY], F.struct(*VALUES).alias("__new"))
    return stored.join(F.broadcast(incoming), [F.col(c) == F.col(f"__{c}") for c in KEY], "left").drop(*[f"__{c}" for c in KEY])


def upsert(spark: SparkSession, folder: str, incoming: DataFrame) -> DataFrame:
    """Merge ``incoming`` (``BAR`` and version) and return a row for each of its keys: kind (insert, replace, none) and the bar as it is now."""
    state = catalogue(spark, folder)
    number = state["number"] + 1
    newest = incoming.groupBy(*KEY).agg(F.max_by(F.struct(*VALUES), "version").alias("v")).select(*KEY, "v.*")
    newest.withColumn("day", F.expr(f"open_ns div {DAY}")).write.mode("overwrite").parquet(f"{folder}/incoming/{number}")
    new = spark.read.parquet(f"{folder}/incoming/{number}")
    days = [r[0] for r in new.select("day").distinct().collect()]  # as many as the upsert touches
    slices = new.count() // SLICE + 1
    spark.createDataFrame([], CHANGE).write.mode("overwrite").parquet(f"{folder}/changes/{number}/slice=-1")
    stored = bars(spark, folder, days)
    merged = stored
    for k in range(slices):
        part = new.where(F.pmod(F.xxhash64(*KEY), F.lit(slices)) == k).drop("day")
        met = _judged(stored, part).where(F.col("__new").isNotNull())
        same = F.struct(*VALUES) == F.col("__new")
        known = met.select(F.when(same, "none").otherwise("replace").alias("kind"), *KEY, "__new.*")
        known.write.mode("overwrite").parquet(f"{folder}/changes/{number}/slice={k}/known=1")
        known = spark.read.schema(CHANGE).parquet(f"{folder}/changes/{number}/slice={k}/known=1")
        part.join(known.select(*KEY), KEY, "left_anti").select(F.lit("insert").alias("kind"), *KEY, *VALUES).write.mode("overwrite").parquet(f"{folder}/changes/{number}/slice={k}/known=0")
        merged = _judged(merged, part).select(*KEY, *[F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) for c in VALUES])
    changes = spark.read.schema(CHANGE).option("recursiveFileLookup", True).parquet(f"{folder}/changes/{number}")
    inserts = changes.where("kind = 'insert'").drop("kind")
    merged.unionByName(inserts).withColumn("day", F.expr(f"open_ns div {DAY}")).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/data/{number}")
    commit(spark, folder, {"number": number, "days": state["days"] | {str(d): number for d in days}})
    return changes
