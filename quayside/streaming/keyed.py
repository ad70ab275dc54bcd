"""Starting a stream whose state Spark keeps by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: Several kinds of state under one key need this provider.
_SETTING, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(rows: DataFrame, key: str, processor: StatefulProcessor, output: str, folder: str, query_name: str | None = None, *, beside: DataFrame | None = None) -> StreamingQuery:
    """Run ``processor`` by ``key`` over what is available of ``rows``; its emissions are stored in ``folder``/emitted.

    A stream that is started again in the same folder goes on from its
    checkpoint: input that it has taken is not taken twice, and emissions of a
    batch that failed half-way are not read.

    beside: rows with columns of ``output`` that are emitted as they come, in the
    micro-batch that takes them, and meet no state; all emissions then have a
    column ``batch``.
    """
    conf = rows.sparkSession.conf
    found = rows.groupBy(key).transformWithState(processor, output, "Append", "None")

    def store(emitted: DataFrame, number: int) -> None:
        emitted.write.mode("overwrite").parquet(f"{folder}/emitted/batch={number}")

    if beside is None:
        writer = found.writeStream.format("parquet").option("path", f"{folder}/emitted")
    else:
        writer = found.unionByName(beside, allowMissingColumns=True).writeStream.foreachBatch(store)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    before = conf.get(_SETTING)
    conf.set(_SETTING, _ROCKS)  # a query keeps what it was started with
    try:
        return (writer.queryName(query_name) if query_name else writer).start()
    finally:
        conf.set(_SETTING, before)
