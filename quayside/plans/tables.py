"""DataFrame queries over ticks, bars, series, positions, fills and ledger entries.

The SQL of the same names in ``catalogue`` is their oracle only; what runs on
Spark is written here, from the same rules, with the library's operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.functions import scalars
from quayside.functions.scalars import midpoint, whole_quotient
from quayside.operators import joins
from quayside.streaming.bars import bars_of

DAY, HOUR, MINUTE = 86_400_000_000_000, 3_600_000_000_000, 60_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros_of(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def ticks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks, each with the session of its instrument and day."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    us = micros_of("ts")
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), (F.col("user_id") % 6 + 1).alias("inst"), (us * 1000).alias("ts_ns"), F.round(F.col("value") * 100).cast("long").alias("px"), k.alias("k"), "event_type", "user_id", "event_id", "props", us.alias("us"))
    rows = rows.withColumn("day", F.expr(f"ts_ns div {DAY}")).withColumn("recv_ns", F.col("ts_ns") + F.col("k") * 1_000_000_000)
    return rows.withColumn("s_open", F.col("day") * DAY + F.col("inst") % 3 * HOUR).withColumn("s_close", F.col("day") * DAY + 81_000_000_000_000)


def in_session(ticks: DataFrame) -> DataFrame:
    return ticks.where((F.col("ts_ns") >= F.col("s_open")) & (F.col("ts_ns") < F.col("s_close")))


def all_bars(spark: SparkSession, sf_dir: str, *minutes: int) -> DataFrame:
    """inst, minutes, s_open, s_close, open_ns, close_ns, o, h, l, c, n, first_seq, last_seq."""
    found = bars_of(ticks_of(spark, sf_dir), minutes or (4, 20, 120, 240))
    s_open = F.col("session_day") * DAY + F.col("inst") % 3 * HOUR
    return found.select(
        "inst", F.col("minutes").cast("long").alias("minutes"), s_open.alias("s_open"), (F.col("session_day") * DAY + 81_000_000_000_000).alias("s_close"), "open_ns", "close_ns",
        F.col("first.px").alias("o"), "h", "l", F.col("last.px").alias("c"), "n", F.col("first.seq").alias("first_seq"), F.col("last.seq").alias("last_seq"),
    )


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


@query
def ohlc_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_bars(spark, sf_dir).drop("s_open", "s_close")


@query
def bars_partial_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = F.col("close_ns") - F.col("open_ns") < F.col("minutes") * MINUTE
    return all_bars(spark, sf_dir).select("inst", "minutes", "open_ns", "close_ns", partial.alias("partial_end"), F.when(partial, F.lit(2 | 8)).otherwise(F.lit(2)).alias("flags"))


@query
def bar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_bars(spark, sf_dir).groupBy("minutes").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("n").alias("n_ticks"), F.min("open_ns").alias("first_open"), F.max("close_ns").alias("last_close"))


@query
def bars_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = ticks_of(spark, sf_dir).agg(F.max("ts_ns").alias("mark"))  # one row
    return all_bars(spark, sf_dir).join(F.broadcast(mark)).where(F.col("close_ns") <= F.col("mark")).select("inst", "minutes", "open_ns", "c").orderBy("open_ns", "inst", "minutes")


@query
def late_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a bar that came after its close."""
    ticks = in_session(ticks_of(spark, sf_dir)).withColumn("minutes", F.explode(F.array(*[F.lit(m).cast("long") for m in (4, 20, 120, 240)])))
    step = F.col("minutes") * MINUTE
    opened = F.col("s_open") + whole_quotient(F.col("ts_ns") - F.col("s_open"), step) * step
    late = F.col("recv_ns") > F.least(F.col("open_ns") + step, F.col("s_close"))
    return ticks.withColumn("open_ns", opened).groupBy("inst", "minutes", "open_ns").agg(count_if(late).alias("revision"), F.count(F.lit(1)).alias("n"))


@query
def rejected_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = ticks_of(spark, sf_dir)
    return ticks.join(in_session(ticks).select("seq"), "seq", "left_anti").select("seq", "inst", "ts_ns")


@query
def asof_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = ticks_of(spark, sf_dir)
    cut = ticks.agg((F.min("ts_ns") + whole_quotient(F.max("ts_ns") - F.min("ts_ns"), F.lit(2))).alias("cutoff"))  # one row
    return ticks.join(F.broadcast(cut)).where(F.col("recv_ns") <= F.col("cutoff")).select("seq", "inst", "recv_ns", "px")


@query
def replay_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a gap: a new one begins where the number before is missing; named as its first number less its place."""
    fit = ticks_of(spark, sf_dir).where("k >= 30").select(F.expr("(seq - 1) div 1000").alias("batch"), "seq")
    w = Window.partitionBy("batch").orderBy("seq")
    starts = fit.withColumn("starts", F.coalesce(F.col("seq") != F.lag("seq").over(w) + 1, F.lit(True))).withColumn("place", F.row_number().over(w))
    named = starts.withColumn("run", F.last(F.when(F.col("starts"), F.col("seq") - F.col("place")), ignorenulls=True).over(w))
    return named.groupBy("batch", "run").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(spark, sf_dir).groupBy("user_id", "event_type", "k").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("copies"))


@query
def dup_batch_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = ticks_of(spark, sf_dir)
    key = ["user_id", "event_type", "k"]
    first = ticks.groupBy(*key).agg(F.min("seq").alias("first_seq"))
    dup = F.col("seq") != F.col("first_seq")
    return ticks.join(first, key).groupBy(F.expr("(seq - 1) div 1000").alias("batch")).agg(F.count(F.lit(1)).alias("n"), count_if(dup).alias("n_dup"), (count_if(dup) == 0).alias("accepted"))


@query
def session_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = ticks_of(spark, sf_dir)
    sessions = ticks.select("inst", F.col("s_open").alias("from_ns"), F.col("s_close").alias("to_ns")).distinct()
    met = joins.interval_join(ticks.select("seq", "inst", "ts_ns"), sessions, on=["inst"], at="ts_ns", start="from_ns", end="to_ns", cell=DAY)
    return met.withColumnsRenamed({"from_ns": "s_open", "to_ns": "s_close"}).withColumn("into_session", F.col("ts_ns") - F.col("s_open"))


@query
def symbol_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = ticks_of(spark, sf_dir)
    change, end = 1_705_276_800_000_000_000, 1_800_000_000_000_000_000
    name = lambda x: F.concat(F.lit("I:"), F.col("inst").cast("string"), F.lit(x))
    spans = F.array(F.struct(name("A").alias("symbol"), F.lit(1).cast("long").alias("version"), F.lit(1_600_000_000_000_000_000).alias("from_ns"), F.lit(change).alias("to_ns")), F.struct(name("B").alias("symbol"), F.lit(2).cast("long").alias("version"), F.lit(change).alias("from_ns"), F.lit(end).alias("to_ns")))
    bindings = ticks.select("inst").distinct().select("inst", F.inline(spans))
    return joins.interval_join(ticks.select("seq", "inst", "ts_ns"), bindings, on=["inst"], at="ts_ns", start="from_ns", end="to_ns", cell=365 * DAY).select("seq", "inst", "symbol", "version")


@query
def authority_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = ticks_of(spark, sf_dir)
    owners = ticks.select("inst").distinct().select("inst", F.when(F.col("inst") % 2 == 0, "view").otherwise("click").alias("event_type"))
    return ticks.join(owners, ["inst", "event_type"], "left_anti").select("seq", "inst", "event_type")


@query
def scd2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = micros_of("o_orderdate")
    spans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", us.alias("from_ns"), (us + F.col("o_orderkey") % 90 * 86_400_000_000).alias("to_ns"))
    prior = F.lag("to_ns").over(Window.partitionBy("o_custkey").orderBy("from_ns", "o_orderkey"))
    return spans.withColumn("prior_to", prior).where(F.col("prior_to") > F.col("from_ns")).drop("to_ns")


@query
def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(spark, sf_dir).groupBy("inst").agg(F.max(F.struct("seq", "px", "ts_ns")).alias("x")).select("inst", "x.*")


def quotes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks_of(spark, sf_dir).where("event_type = 'view'")
    return t.select("seq", "inst", "ts_ns", (F.col("px") - F.col("event_id") % 7).alias("bid"), (F.col("px") + F.col("event_id") % 5).alias("ask"))


@query
def last_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_of(spark, sf_dir).groupBy("inst").agg(F.max(F.struct("seq", "bid", "ask")).alias("x")).select("inst", "x.*")


@query
def quote_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = whole_quotient(F.col("bid") + F.col("ask"), F.lit(2))
    return quotes_of(spark, sf_dir).select("seq", "inst", "bid", "ask", mid.alias("mid"), (F.col("bid") <= F.col("ask")).alias("valid"))


@query
def projector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(spark, sf_dir).groupBy("inst").agg(
        F.count(F.lit(1)).alias("n_seen"), count_if(F.col("event_type") == "error").alias("n_errors"), count_if(F.col("event_type") == "view").alias("n_quotes"), count_if(F.col("recv_ns") < F.col("ts_ns")).alias("n_early"), F.max("recv_ns").alias("last_received")
    )


@query
def batch_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live if one event of the batch is, else that of the last one."""
    state = F.when(F.col("event_type") == "error", "stale").when(F.col("k") >= 60, "delayed").otherwise("live")
    rows = ticks_of(spark, sf_dir).select(F.expr("(seq - 1) div 1000").alias("batch"), "seq", state.alias("state"))
    each = rows.groupBy("batch").agg(F.bool_or(F.col("state") == "live").alias("live"), F.max_by("state", "seq").alias("last"))
    return each.select("batch", F.when(F.col("live"), "live").otherwise(F.col("last")).alias("availability"))


@query
def flags_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    quality = F.shiftright(k, 4).bitwiseAND(7)
    bits = [scalars.flag(k, b).alias(n) for b, n in enumerate(("provisional", "final", "correction", "partial_end"))]
    return ticks_of(spark, sf_dir).select("seq", *bits, F.when(quality > 4, F.lit(0)).otherwise(quality).cast("long").alias("quality"))


def receipts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("receipt_id"), "source", (F.col("doc_id") % 4).alias("license"), "n_chars", F.col("text").alias("payload"))


@query
def license_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lic = F.col("license")
    return receipts_of(spark, sf_dir).select("receipt_id", "license", lic.isin(1, 2, 3).alias("may_retain"), (lic == 3).alias("may_export"), (lic > 1).alias("may_share"))


@query
def license_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts_of(spark, sf_dir).groupBy("source", "license").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts_of(spark, sf_dir).select("receipt_id", F.md5(F.col("payload").cast("binary")).alias("payload_md5"), "n_chars")


@query
def receipt_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("receipt_id")
    return receipts_of(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), last.alias("last_receipt"), (last + 1).alias("next_receipt"))


@query
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def observations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("series"), period.alias("period"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"), (F.col("o_custkey") % 3).alias("source"))


def vintages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_of(spark, sf_dir).groupBy("series", "period").agg(F.max(F.struct("seq", "v")).alias("x")).select("series", "period", "x.v", "x.seq")


@query
def latest_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vintages_of(spark, sf_dir)


@query
def macro_history36(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("period"))).cast("long")
    return vintages_of(spark, sf_dir).withColumn("r", place).where("r <= 36").select("series", "period", "v", "r")


@query
def macro_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vintages_of(spark, sf_dir)
    return v.select("series", "period", "v", (F.col("v") - F.lag("v").over(Window.partitionBy("series").orderBy("period"))).alias("delta"))


@query
def macro_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_of(spark, sf_dir).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("period").alias("n_periods"), F.count_distinct("source").alias("n_sources"), F.max("seq").alias("as_of"))


def corrections_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.lag("v").over(Window.partitionBy("series", "period").orderBy("seq"))
    return observations_of(spark, sf_dir).withColumn("prior", prior).withColumn("corrected", F.coalesce(F.col("prior") != F.col("v"), F.lit(False)))


@query
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections_of(spark, sf_dir).select("series", "period", "seq", "v", "prior", "corrected")


@query
def correction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections_of(spark, sf_dir).groupBy("series").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("corrected")).alias("n_corrected"))


def positions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    side = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, cents).otherwise(F.lit(0)))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("participant"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("period"))
    return rows.agg(side("O").alias("long_q"), side("F").alias("short_q"))


def nets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("participant").orderBy(F.desc("period"))).cast("long")
    return positions_of(spark, sf_dir).select("participant", "period", (F.col("long_q") - F.col("short_q")).alias("net"), place.alias("r"))


@query
def positioning_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of weeks not above the latest one: its cumulative distribution over the last 104."""
    recent = nets_of(spark, sf_dir).where("r <= 104")
    ranked = recent.withColumn("below", F.count(F.lit(1)).over(Window.partitionBy("participant").orderBy("net").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    n = recent.groupBy("participant").agg(F.count(F.lit(1)).alias("n_weeks"))
    latest = ranked.where("r = 1").join(n, "participant")
    return latest.select("participant", F.col("net").alias("latest_net"), "n_weeks", F.col("below").alias("n_below"), F.round(100.0 * F.col("below") / F.col("n_weeks"), 6).alias("pct"))


@query
def positioning_hist104(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nets_of(spark, sf_dir).where("r <= 104")


@query
def positioning_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("net").over(Window.partitionBy("participant").orderBy("period"))
    return nets_of(spark, sf_dir).select("participant", "period", "net", (F.col("net") - before).alias("change"))


@query
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("cataloged"), count_if(F.col("o_orderstatus") == "F").alias("current_n"))


def regional_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query
def context_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family")).distinct()
    grid = table(spark, sf_dir, "region").crossJoin(families)  # a row for each region and family
    seen = regional_orders(spark, sf_dir).groupBy("n_regionkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("latest"))
    out = grid.join(seen, (F.col("r_regionkey") == F.col("n_regionkey")) & (F.col("family") == F.col("o_orderpriority")), "left")
    return out.select(F.col("r_name").alias("region"), "family", F.coalesce("n", F.lit(0)).alias("n"), "latest")


@query
def region_series_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = regional_orders(spark, sf_dir).groupBy(F.col("n_regionkey").alias("region"), F.col("o_orderpriority").alias("category")).agg(F.max(F.struct("o_orderkey", "o_custkey")).alias("x"))
    return newest.select("region", "category", F.col("x.o_orderkey").alias("latest_key"), F.col("x.o_custkey").alias("latest_source"))


@query
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the five series each period lacks."""
    o = observations_of(spark, sf_dir)
    expected = o.select("period").distinct().select("period", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    there = o.groupBy("period").agg(F.count_distinct("series").alias("n"))
    return expected.groupBy("period").agg(F.count(F.lit(1)).alias("wanted")).join(there, "period").select("period", (F.col("wanted") - F.col("n")).alias("missing"))


@query
def unpivot_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = positions_of(spark, sf_dir).select("participant", "period", F.col("long_q").alias("long"), F.col("short_q").alias("short"), (F.col("long_q") - F.col("short_q")).alias("net"))
    return wide.unpivot(["participant", "period"], ["long", "short", "net"], "side", "qty")


def fills_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("unknown")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fill_id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey"), (F.col("l_partkey") % 6 + 1).alias("inst"), scalars.micros(F.col("l_quantity")).alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), side.alias("side")
    )


@query
def unknown_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("order_id"))
    return joins.missing(fills_of(spark, sf_dir), known, ["order_id"]).groupBy("order_id").agg(F.count(F.lit(1)).alias("n_fills"))


@query
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1).otherwise(0)
    return fills_of(spark, sf_dir).groupBy("inst").agg(F.sum(sign * F.col("qty")).alias("net_qty"), F.sum(-sign * F.col("price")).alias("cash"))


@query
def fills_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = fills_of(spark, sf_dir).groupBy("fill_id", "order_id").agg(F.max("qty").alias("qty"))
    return once.groupBy("order_id").agg(F.sum("qty").alias("filled"), F.count(F.lit(1)).alias("n_fills"))


@query
def recon_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("order_id"))
    return joins.missing(fills_of(spark, sf_dir), live, ["order_id"]).groupBy("fill_id").agg(F.count(F.lit(1)).alias("n"))


@query
def order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fills_of(spark, sf_dir).select(F.col("order_id").alias("o_orderkey"), F.lit(True).alias("filled")).distinct()
    state = F.when(F.col("filled"), "partially_filled").otherwise("working")
    return table(spark, sf_dir, "orders").join(filled, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", state.alias("state"))


@query
def contract_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_part = fills_of(spark, sf_dir).groupBy("l_partkey", "inst").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))
    met = per_part.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy("inst", "p_brand").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


@query
def limit_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.used_share(F.col("c_acctbal"), F.lit(9000.0)), 9).alias("used"))


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("event_id") + 1).alias("entry_id"), F.col("user_id").alias("case_id"), (F.col("event_id") % 18 + 1).alias("kind"), (F.col("user_id") % 97).alias("correlation"), (micros_of("ts") * 1000).alias("event_ns"), F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(F.col("user_id") % 6 + 1).alias("inst"), F.col("event_type").alias("body"))
    return rows.withColumn("parent_id", F.lag("entry_id").over(Window.partitionBy("case_id").orderBy("entry_id")))


@query
def ledger_rows256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(spark, sf_dir).drop("parent_id").select("entry_id", "case_id", "kind", "event_ns").orderBy(F.desc("entry_id")).limit(256)


@query
def ledger_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case by its last entry; its instrument is the last one that an entry names."""
    cases = entries_of(spark, sf_dir).groupBy("case_id").agg(F.max(F.struct("entry_id", "event_ns", "kind", "body")).alias("x"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("inst") != 0, F.struct("entry_id", "inst"))).alias("y"))
    return cases.select("case_id", F.col("x.entry_id").alias("last_entry"), F.col("x.event_ns").alias("last_event_ns"), F.col("x.kind").alias("last_kind"), F.col("x.body").alias("preview"), "n", F.coalesce("y.inst", F.lit(0).cast("long")).alias("inst"))


@query
def case_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = entries_of(spark, sf_dir).groupBy("correlation").agg(F.min(F.struct("entry_id", "case_id")).alias("x"), F.count_distinct("case_id").alias("n_cases"))
    return first.select("correlation", F.col("x.case_id").alias("first_case"), F.col("x.entry_id").alias("first_entry"), "n_cases")


@query
def parent_case_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose parent is not of a smaller kind."""
    e = entries_of(spark, sf_dir)
    parents = e.select(F.col("entry_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    met = e.join(parents, "parent_id")
    return met.where(F.col("parent_kind") >= F.col("kind")).select("entry_id", "parent_id")


@query
def causal_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_of(spark, sf_dir).select("entry_id", "parent_id")
    children = e.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("entry_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return e.join(children, "entry_id", "left").select("entry_id", "parent_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query
def body_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts_of(spark, sf_dir).select("receipt_id", scalars.body_preview(F.col("payload")).alias("preview"))


@query
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_of(spark, sf_dir).select((F.col("case_id") * 100 + F.col("kind")).alias("source_key"), "entry_id")
    attempts = e.groupBy("source_key").agg(F.count(F.lit(1)).alias("attempts"))
    return e.groupBy("source_key").agg(F.min("entry_id").alias("kept")).join(attempts, "source_key")


def m4_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_bars(spark, sf_dir, 4)


def session_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inst, s_open, hi, lo, and the first bars that reached them."""
    return m4_of(spark, sf_dir).groupBy("inst", "s_open").agg(F.max("h").alias("hi"), F.min("l").alias("lo"), F.max(F.struct("h", (-F.col("open_ns")).alias("at"), "o", "c")).alias("top"), F.min(F.struct("l", "open_ns", "o", "c")).alias("low"))


@query
def session_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar sets a new extreme when it is the first of its session at that running extreme."""
    w = Window.partitionBy("inst", "s_open").orderBy("open_ns")
    run = m4_of(spark, sf_dir).withColumn("hi", F.max("h").over(w)).withColumn("lo", F.min("l").over(w))
    new = lambda c: F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(True))
    return run.select("inst", "open_ns", "h", "l", new("hi").alias("new_high"), new("lo").alias("new_low"))


@query
def extreme_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_ranges(spark, sf_dir)
    return s.select("inst", "s_open", "hi", F.greatest("top.o", "top.c").alias("upper_low"), "lo", F.least("low.o", "low.c").alias("lower_high"))


@query
def prev_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("inst").orderBy("s_open")  # one row for each session
    return session_ranges(spark, sf_dir).select("inst", "s_open", "hi", "lo", F.lag("hi").over(w).alias("prev_hi"), F.lag("lo").over(w).alias("prev_lo"))


@query
def opening_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = m4_of(spark, sf_dir).where(F.col("open_ns") - F.col("s_open") < 20 * MINUTE)
    return early.groupBy("inst", "s_open").agg(F.max("h").alias("hi"), F.min("l").alias("lo"), midpoint(F.min("l"), F.max("h")).alias("mid"), F.count(F.lit(1)).alias("n"))


@query
def level_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.operators.structure import SESSION, level_id

    sessions = m4_of(spark, sf_dir).select("inst", "s_open").distinct().withColumn("r", F.row_number().over(Window.partitionBy("inst").orderBy("s_open")).cast("long"))
    number = F.when(F.col("r") == 1, F.lit(1)).otherwise(6 * F.col("r") - 7)
    return sessions.select("inst", "s_open", level_id(SESSION, F.col("inst"), number).alias("first_id"))


@query
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_ranges(spark, sf_dir).select("inst", "s_open", "hi", "lo", midpoint(F.col("lo"), F.col("hi")).alias("center"))
    w = Window.partitionBy("inst").orderBy("lo", "hi", "s_open")  # one row for each session
    nxt = s.withColumn("next_low", F.lead("lo").over(w)).withColumn("next_center", F.lead("center").over(w)).where(F.col("next_low").isNotNull())
    width = F.greatest(F.col("next_low") - F.col("hi"), F.lit(0).cast("long"))
    return nxt.select("inst", "center", "next_center", width.alias("width"), scalars.ratio_ppm(width, F.col("hi") - F.col("lo")).alias("ppm"))


@query
def slot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = whole_quotient(F.col("open_ns") - F.col("s_open"), F.lit(4 * MINUTE))
    w = Window.partitionBy("inst", "s_open").orderBy("slot")
    return m4_of(spark, sf_dir).select("inst", "s_open", slot.alias("slot")).withColumn("missing_before", F.col("slot") - 1 - F.coalesce(F.lag("slot").over(w), F.lit(-1)))


@query
def visible_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = F.greatest(whole_quotient((F.col("hi") - F.col("lo")) * 9, F.lit(100)), F.lit(1).cast("long"))
    return session_ranges(spark, sf_dir).select("inst", "s_open", "lo", "hi", (F.col("lo") - pad).alias("floor_px"), (F.col("hi") + pad).alias("top_px"))


@query
def bar_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar that comes twice, first with its open as close: the later one replaces the earlier."""
    bars = all_bars(spark, sf_dir).select("inst", "minutes", "open_ns", F.inline(F.array(F.struct((F.col("first_seq") - 1).alias("version"), F.col("o").alias("close")), F.struct(F.col("last_seq").alias("version"), F.col("c").alias("close")))))
    return bars.groupBy("inst", "minutes", "open_ns").agg(F.max(F.struct("version", "close")).alias("x"), F.count(F.lit(1)).alias("versions")).select("inst", "minutes", "open_ns", F.col("x.close").alias("c"), "versions")
