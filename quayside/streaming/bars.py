"""Session-anchored bars of all timeframes on a stream of ticks.

Bars are kept as state, one row each, in folders by session day.  A micro-batch
is summed up by bar first; only the days that it touches, and those with a bar
that is now due, are read, merged and written again under the batch's number, so
what a batch costs does not grow with the history.  A manifest tells which batch
wrote a day last.  A batch that runs again reads what was there before it and
overwrites itself.

A bar is emitted when its close is not after the largest tick time of the batch
(of this batch alone: the mark may fall) and something about it was not emitted
yet.  Late ticks are never dropped: they emit the bar again, marked as a
correction, with a revision that counts the ticks since its first emission.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MINUTE = 60_000_000_000
DAY = 86_400_000_000_000
#: Minutes of the timeframes.
TIMEFRAMES = (4, 20, 120, 240)
KEY = ["inst", "minutes", "open_ns"]
_POINT = "struct<ts_ns:bigint,seq:bigint,px:bigint>"
STATE = f"inst bigint, minutes int, open_ns bigint, close_ns bigint, session_day bigint, first {_POINT}, last {_POINT}, h bigint, l bigint, n bigint, revision bigint, emitted bigint"
EMITTED = "inst bigint, minutes int, open_ns bigint, close_ns bigint, o bigint, h bigint, l bigint, c bigint, n bigint, revision bigint, correction boolean, batch bigint"
MANIFEST = "session_day bigint, due_ns bigint, batch bigint"


def bars_of(ticks: DataFrame, timeframes: tuple[int, ...] = TIMEFRAMES) -> DataFrame:
    """What ticks (inst, seq, ts_ns, px, s_open, s_close) add to each bar, anchored at the session's open and cut at its close."""
    inside = ticks.where((F.col("ts_ns") >= F.col("s_open")) & (F.col("ts_ns") < F.col("s_close")))
    framed = inside.withColumn("minutes", F.explode(F.array(*map(F.lit, timeframes))))
    step = F.col("minutes").cast("long") * MINUTE
    opened = F.col("s_open") + F.expr("(ts_ns - s_open) div (cast(minutes as bigint) * 60000000000)") * step
    point = F.struct("ts_ns", "seq", "px")
    keyed = framed.withColumn("open_ns", opened).withColumn("close_ns", F.least(F.col("open_ns") + step, F.col("s_close"))).withColumn("session_day", F.expr(f"s_open div {DAY}"))
    return keyed.groupBy(*KEY, "close_ns", "session_day").agg(F.min(point).alias("first"), F.max(point).alias("last"), F.max("px").alias("h"), F.min("px").alias("l"), F.count(F.lit(1)).alias("n"))


def merged(state: DataFrame, added: DataFrame) -> DataFrame:
    """``state`` after the bars ``added``: ticks that come after a bar's first emission count as its revisions."""
    new = added.select("*", F.lit(None).cast("long").alias("revision"), F.lit(None).cast("long").alias("emitted"), F.col("n").alias("fresh"))
    both = state.withColumn("fresh", F.lit(0).cast("long")).unionByName(new)
    out = both.groupBy(*KEY, "close_ns", "session_day").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("h").alias("h"), F.min("l").alias("l"), F.sum("n").alias("n"), F.max("revision").alias("revision"), F.max("emitted").alias("emitted"), F.sum("fresh").alias("fresh")
    )
    late = F.when(F.col("emitted").isNotNull(), F.col("fresh")).otherwise(F.lit(0))
    return out.withColumn("revision", F.coalesce("revision", F.lit(0).cast("long")) + late).drop("fresh")


def replayed(ticks: DataFrame, timeframes: tuple[int, ...] = TIMEFRAMES) -> DataFrame:
    """The bars of a whole history at once: what a stream over the same ticks has emitted last, but for revisions."""
    mark = ticks.agg(F.max("ts_ns").alias("mark"))  # one row
    found = bars_of(ticks, timeframes).join(F.broadcast(mark)).where(F.col("close_ns") <= F.col("mark"))
    return found.select(*KEY, "close_ns", F.col("first.px").alias("o"), "h", "l", F.col("last.px").alias("c"), "n")


def stream_bars(ticks: DataFrame, folder: str, *, timeframes: tuple[int, ...] = TIMEFRAMES, query_name: str | None = None) -> StreamingQuery:
    """Start the stream over what is available; emissions are stored in ``folder``/emitted.

    ticks: streaming rows of inst, seq, ts_ns, px, s_open, s_close.
    """

    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], EMITTED).drop("batch").write.mode("overwrite").parquet(f"{folder}/emitted/batch={number}")
        spark.createDataFrame([], MANIFEST).drop("batch").write.mode("overwrite").parquet(f"{folder}/manifest/batch={number}")
        batch.write.mode("overwrite").parquet(f"{folder}/ticks/{number}")
        stored = spark.read.schema(batch.schema).parquet(f"{folder}/ticks/{number}")
        mark = stored.agg(F.max("ts_ns")).first()[0]
        if mark is None:
            return
        days = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where(F.col("batch") < number)
        newest = days.groupBy("session_day").agg(F.max(F.struct("batch", "due_ns")).alias("d")).select("session_day", "d.*")
        touched = stored.select(F.expr(f"s_open div {DAY}").alias("session_day")).distinct()
        # One row for each day that is read: bounded by the days of the history.
        wanted = newest.join(touched.withColumn("touched", F.lit(True)), "session_day", "left").where(F.col("touched") | (F.col("due_ns") <= mark)).select("session_day", "batch").collect()
        paths = [f"{folder}/state/{r.batch}/session_day={r.session_day}" for r in wanted]
        columns = [c.split()[0] for c in STATE.split(", ")]
        state = spark.read.schema(STATE).option("basePath", f"{folder}/state").parquet(*paths).select(*columns) if paths else spark.createDataFrame([], STATE)
        now = merged(state, bars_of(stored, timeframes))
        due = (F.col("close_ns") <= mark) & (F.col("emitted").isNull() | (F.col("emitted") != F.col("revision")))
        marked = now.withColumn("due", due)
        marked.write.mode("overwrite").parquet(f"{folder}/merged/{number}")
        marked = spark.read.schema(marked.schema).parquet(f"{folder}/merged/{number}")
        out = marked.where("due").select(*KEY, "close_ns", F.col("first.px").alias("o"), "h", "l", F.col("last.px").alias("c"), "n", "revision", F.col("emitted").isNotNull().alias("correction"))
        settled = marked.withColumn("emitted", F.when(F.col("due"), F.col("revision")).otherwise(F.col("emitted"))).drop("due")
        settled.repartition("session_day").write.mode("overwrite").partitionBy("session_day").parquet(f"{folder}/state/{number}")
        waiting = F.when(F.col("emitted").isNull() | (F.col("emitted") != F.col("revision")), F.col("close_ns"))
        settled.groupBy("session_day").agg(F.min(waiting).alias("due_ns")).write.mode("overwrite").parquet(f"{folder}/manifest/batch={number}")
        out.write.mode("overwrite").parquet(f"{folder}/emitted/batch={number}")

    writer = ticks.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    return (writer.queryName(query_name) if query_name else writer).start()
