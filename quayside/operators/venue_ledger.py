"""Ledger entries of decoded venue epochs, and the state of reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scalars import key128, lifecycle_correlation, micros, millis_to_ns, signed
from quayside.sources.venue import side

ENTRY = ("epoch_id", "source_key", "correlation", "kind", "status", "inst", "account_id", "event_ns", "body")


def _quantity(value: Column) -> Column:
    return F.format_string("%.6f", value)


def _price(value: Column) -> Column:
    return F.format_string("%.5f", value)


def entries(decoded: DataFrame, unknown: DataFrame, *, venue: str = "Venue", currency: str = "USD") -> DataFrame:
    """One entry for each accepted epoch, and one for each of its orders, positions and executions.

    unknown: (epoch_id, id), objects that nobody knows.  Equal states of one
    object have one source_key, so appending them again adds nothing.
    """
    fine = decoded.where(F.col("rejected").isNull())
    strange = unknown.groupBy("epoch_id").agg(F.count(F.lit(1)).alias("strange"))
    upper = lambda c: F.upper(side(c))
    whole = fine.join(strange, "epoch_id", "left").withColumn("strange", F.coalesce("strange", F.lit(0).cast("long")))
    counts = [F.size(c) for c in ("contracts", "quotes", "positions", "orders", "executions")]
    epochs = whole.select(
        "epoch_id", key128(F.lit("epoch"), F.col("epoch_id"), F.col("as_of_ns")).alias("source_key"), F.lit(None).cast("string").alias("correlation"), F.lit("reconciliation").alias("kind"),
        F.when(F.col("strange") == 0, "accepted").otherwise("incident").alias("status"), F.lit(0).cast("long").alias("inst"), "account_id", F.col("as_of_ns").alias("event_ns"),
        F.format_string(f"{venue} epoch %d: %d contracts, %d quotes, %d positions, %d open orders, %d executions, %d unknown objects.", "epoch_id", *counts, "strange").alias("body"),
    )
    rows = lambda df, c: df.select("epoch_id", "account_id", "as_of_ns", F.explode(c).alias("r")).select("epoch_id", "account_id", "as_of_ns", "r.*")
    orders = rows(fine.withColumn("every", F.concat("orders", "order_history")), "every")
    orders = orders.select(
        "epoch_id", key128(F.lit("order"), F.col("id"), F.col("status"), F.col("createdDate"), micros(F.col("filledQty"))).alias("source_key"),
        lifecycle_correlation(F.col("account_id"), F.col("positionId"), F.col("id")).alias("correlation"), F.lit("order").alias("kind"),
        F.when(F.col("isOpen") == "true", "pending").otherwise("accepted").alias("status"), "inst", "account_id", millis_to_ns(F.col("createdDate"), F.col("as_of_ns")).alias("event_ns"),
        F.format_string(f"{venue} order %d %s %s %s @ %s / status %s.", "id", upper(F.col("side")), _quantity(F.col("qty")), "type", _price(F.col("avgPrice")), "status").alias("body"),
    )
    positions = rows(fine, "positions")
    positions = positions.select(
        "epoch_id", key128(F.lit("position"), F.col("id"), micros(F.col("qty")), F.col("avgPrice"), micros(F.col("unrealizedPl")), F.col("openDate")).alias("source_key"),
        lifecycle_correlation(F.col("account_id"), F.col("id"), F.col("id")).alias("correlation"), F.lit("position").alias("kind"), F.lit("observed").alias("status"),
        "inst", "account_id", millis_to_ns(F.col("openDate"), F.col("as_of_ns")).alias("event_ns"),
        F.format_string(f"{venue} position %d %s %s @ %s / open P&L %s {currency}.", "id", upper(F.col("side")), _quantity(F.col("qty")), _price(F.col("avgPrice")), signed(micros(F.col("unrealizedPl")))).alias("body"),
    )
    fills = rows(fine, "executions")
    fills = fills.select(
        "epoch_id", key128(F.lit("execution"), F.col("id"), F.col("orderId"), F.col("positionId"), F.col("createdDate")).alias("source_key"),
        lifecycle_correlation(F.col("account_id"), F.col("positionId"), F.col("orderId")).alias("correlation"), F.lit("fill").alias("kind"), F.lit("accepted").alias("status"),
        "inst", "account_id", millis_to_ns(F.col("createdDate"), F.col("as_of_ns")).alias("event_ns"),
        F.format_string(f"{venue} execution %d filled order %d / position %d / %s %s @ %s.", "id", "orderId", "positionId", upper(F.col("side")), _quantity(F.col("qty")), _price(F.col("price"))).alias("body"),
    )
    return epochs.unionByName(orders).unionByName(positions).unionByName(fills).select(*ENTRY)


def append_once(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The entries of ``new`` whose source_key the ledger lacks, the first of each key by epoch."""
    first = F.row_number().over(Window.partitionBy("source_key").orderBy("epoch_id", "event_ns")) == 1
    fresh = new.withColumn("__first", first).where("__first").drop("__first")
    return fresh.join(ledger.select("source_key"), "source_key", "left_anti").select(*new.columns)


def order_states(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Orders of each epoch after its fills: epoch, order_id, status, filled, position_id.

    orders: epoch, ordinal, order_id, status, filled, position_id, the last row
    of an order counts.  fills: epoch, ordinal, fill_id, order_id, position_id,
    qty; a fill_id counts once in an epoch, with its first row whose order is known.
    """
    last = orders.groupBy("epoch", "order_id").agg(F.max_by(F.struct("status", "filled", "position_id"), "ordinal").alias("o"))
    known = fills.join(last.select("epoch", "order_id"), ["epoch", "order_id"], "left_semi")
    once = known.groupBy("epoch", "fill_id").agg(F.min_by(F.struct("order_id", "position_id", "qty", "ordinal"), "ordinal").alias("f"))
    added = once.groupBy("epoch", F.col("f.order_id").alias("order_id")).agg(F.sum("f.qty").alias("qty"), F.max_by("f.position_id", "f.ordinal").alias("held"))
    out = last.join(added, ["epoch", "order_id"], "left")
    status = F.when(F.col("qty").isNull(), F.col("o.status")).otherwise("partially_filled")
    return out.select("epoch", "order_id", status.alias("status"), (F.col("o.filled") + F.coalesce("qty", F.lit(0))).alias("filled"), F.coalesce("held", "o.position_id").alias("position_id"))


def epoch_states(marks: DataFrame, intents: DataFrame) -> DataFrame:
    """(stream, epoch, state, unknown, ready): each epoch as its last mark left it.

    marks: stream, ordinal, epoch, kind (begin, finish).  An epoch is finished
    by its own finish only, while it is the one begun last.  intents: stream,
    ordinal, intent_id, kind (unknown, resolved); unknown ones outlive epochs.
    """
    w = Window.partitionBy("stream").orderBy("ordinal")
    begun = F.last(F.when(F.col("kind") == "begin", F.col("epoch")), ignorenulls=True).over(w)
    seen = marks.withColumn("begun", begun)
    fits = (F.col("kind") == "begin") | (F.col("epoch") == F.col("begun"))
    states = seen.where(fits).groupBy("stream", "epoch").agg(F.max_by("kind", "ordinal").alias("kind"))
    latest = intents.groupBy("stream", "intent_id").agg(F.max_by("kind", "ordinal").alias("kind")).where("kind = 'unknown'")
    open_ = latest.groupBy("stream").agg(F.count(F.lit(1)).alias("unknown"))
    out = states.join(open_, "stream", "left").withColumn("unknown", F.coalesce("unknown", F.lit(0).cast("long")))
    state = F.when(F.col("kind") == "finish", "ready").otherwise("reconciling")
    return out.select("stream", "epoch", state.alias("state"), "unknown", ((state == "ready") & (F.col("unknown") == 0)).alias("ready"))
