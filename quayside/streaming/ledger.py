"""Appending commands to a ledger in transactions.

The ledger is a folder of Parquet files.  A micro-batch stages its entries, its
outcomes and what it adds to two indexes (source keys and the cases of
correlations, in buckets by hash) under its own number; then one small file is
renamed into ``commits``, and with that all of it counts.  Readers take batches
up to the last commit, so a batch that failed half-way is not seen, and its
re-run overwrites what it staged.  A batch that is committed already is passed
over.

A command is taken once by its source key: one that comes again, in any batch,
gets the entry of the first.  Commands with a problem are refused, as are those
whose case contradicts that of their correlation; a refused key may be tried
again in a later batch, and within a batch the first command without a problem
decides for its key.  The
commands of one epoch are appended all or none.  Entries are numbered without
gaps, and new cases count on, over all batches.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayside.operators.ledger import assign_cases
from quayside.operators.sequences import running_rank

#: Buckets of the indexes; a batch reads those that its keys and correlations fall into.
BUCKETS = 64
#: Number of the first case that the ledger opens; commands name smaller ones.
FIRST_CASE = 1_000_000
#: source_key and correlation: 0 or null for none; epoch: null outside one; cell: never falls along the ordinal.
COMMAND = "ordinal bigint, source_key bigint, policy string, case_id bigint, correlation bigint, epoch bigint, problem string, cell bigint"
KEYS, CASES = "source_key bigint, entry_id bigint, assigned bigint, bucket int, batch bigint", "correlation bigint, known_case bigint, bucket int, batch bigint"
OUTCOME = "ordinal bigint, outcome string, entry_id bigint, assigned bigint, batch bigint"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def committed(spark: SparkSession, folder: str) -> dict:
    """The last commit: number, next_entry, next_case; number -1 before the first."""
    fs, path = _fs(spark, f"{folder}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = sorted(n for n in names if n.endswith(".json"))
    if not done:
        return {"number": -1, "next_entry": 1, "next_case": FIRST_CASE}
    return json.loads(spark.read.text(f"{folder}/commits/{done[-1]}").first()[0])


def commit(spark: SparkSession, folder: str, state: dict) -> None:
    """The switch: what was staged under ``state['number']`` counts from now on."""
    name = f"{state['number']:012d}.json"
    fs, made = _fs(spark, f"{folder}/commits/.{name}.tmp")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    _, final = _fs(spark, f"{folder}/commits/{name}")
    if not fs.rename(made, final):
        raise OSError(f"batch {state['number']} was committed by another writer")


def _seen(spark: SparkSession, folder: str, part: str, schema: str, last: int, buckets: list[int] | None = None) -> DataFrame:
    fs, path = _fs(spark, f"{folder}/{part}")
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(f"{folder}/{part}").where(F.col("batch") <= last)
    return found if buckets is None else found.where(F.col("bucket").isin(buckets))


def snapshot(spark: SparkSession, folder: str, part: str = "entries") -> DataFrame:
    """The ledger's ``entries`` (or ``outcomes``) as of the last commit."""
    schema = OUTCOME if part == "outcomes" else f"{COMMAND}, entry_id bigint, assigned bigint, batch bigint"
    return _seen(spark, folder, part, schema, committed(spark, folder)["number"])


def _bucket(c: str):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _touched(rows: DataFrame, c: str) -> list[int]:
    return [r[0] for r in rows.select(_bucket(c)).distinct().collect()]  # at most BUCKETS


def append(spark: SparkSession, folder: str, commands: DataFrame, number: int) -> None:
    """Append one batch of ``commands`` (``COMMAND``) as number ``number``."""
    last = committed(spark, folder)
    if number <= last["number"]:
        return
    staged = f"{folder}/staged/{number}"
    commands.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(COMMAND).parquet(staged)
    keys = _seen(spark, folder, "keys", KEYS, last["number"], _touched(rows, "source_key")).select("source_key", F.col("entry_id").alias("__entry"), F.col("assigned").alias("__assigned"))
    known = _seen(spark, folder, "cases", CASES, last["number"], _touched(rows, "correlation")).select("correlation", F.col("known_case").alias("case_id"))
    rows = rows.join(keys, "source_key", "left")
    # A problem anywhere in an epoch refuses all of it.
    spoilt = rows.where(F.col("problem").isNotNull() & F.col("epoch").isNotNull() & F.col("__entry").isNull()).select("epoch").distinct()
    while True:
        fit = rows.where(F.col("__entry").isNull() & F.col("problem").isNull()).join(spoilt, "epoch", "left_anti")
        first = fit.groupBy("source_key").agg(F.min("ordinal").alias("ordinal"))
        asked = fit.join(first, ["source_key", "ordinal"]).drop("__entry", "__assigned")
        path = f"{folder}/judged/{number}"
        cases = assign_cases(asked, known, last["next_case"], cell="cell")
        opened = (F.col("policy") == "correlate") & (F.col("assigned") >= last["next_case"])
        cases.withColumn("opened", opened).write.mode("overwrite").parquet(path)
        judged = spark.read.parquet(path)
        refused = judged.where(F.col("assigned").isNull() & F.col("epoch").isNotNull()).select("epoch").distinct()
        more = [r[0] for r in refused.collect()]  # epochs of this batch
        if not more:
            break
        spoilt = spoilt.unionByName(spark.createDataFrame([(e,) for e in more], "epoch bigint"))
    taken = running_rank(judged.where(F.col("assigned").isNotNull()).drop("conflict", "opened"), cell="cell", order=["ordinal"], into="__n")
    taken.withColumn("entry_id", F.col("__n") + (last["next_entry"] - 1)).drop("__n").write.mode("overwrite").parquet(f"{folder}/entries/batch={number}")
    entries = spark.read.parquet(f"{folder}/entries/batch={number}")

    entries.select("source_key", "entry_id", "assigned", _bucket("source_key").alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/keys/batch={number}")
    named = entries.where((F.col("policy") != "none") & (F.coalesce("correlation", F.lit(0)) != 0)).groupBy("correlation").agg(F.min_by("assigned", "ordinal").alias("known_case"))
    named.join(known, "correlation", "left_anti").select("correlation", "known_case", _bucket("correlation").alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/cases/batch={number}")
    mine = entries.select("source_key", F.col("ordinal").alias("__first"), F.col("entry_id").alias("__new"), F.col("assigned").alias("__case"))
    told = rows.join(mine, "source_key", "left")
    new = F.col("__new").isNotNull() & (F.col("ordinal") >= F.col("__first"))
    outcome = F.when(F.col("__entry").isNotNull(), "existing").when(new & (F.col("ordinal") == F.col("__first")), "appended").when(new, "existing").otherwise("refused")
    got = lambda old, fresh: F.when(F.col("__entry").isNotNull(), F.col(old)).when(new, F.col(fresh))
    told.select("ordinal", outcome.alias("outcome"), got("__entry", "__new").alias("entry_id"), got("__assigned", "__case").alias("assigned")).write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")
    opened = judged.where(F.col("opened")).agg(F.max("assigned")).first()[0]
    commit(spark, folder, {"number": number, "next_entry": last["next_entry"] + entries.count(), "next_case": last["next_case"] if opened is None else opened + 1})


def stream_ledger(commands: DataFrame, folder: str, *, query_name: str | None = None) -> StreamingQuery:
    """Append what is available of a stream of commands; its checkpoint lies in the ledger's folder and must stay with it."""

    def process(batch: DataFrame, number: int) -> None:
        append(batch.sparkSession, folder, batch, number)

    writer = commands.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    return (writer.queryName(query_name) if query_name else writer).start()
