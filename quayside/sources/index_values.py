"""Index values from a wire or from snapshots, and checks of the catalogue that names them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import scalars
from quayside.operators import joins

DAY = 86_400_000_000_000
#: Keys differ by case alone (T, t), so events are maps.
WIRE = "map<string,string>"
SNAPSHOT = "status string, results array<struct<ticker:string,type:string,timeframe:string,last_updated:bigint,value:double,error:string>>"


def wire_values(receipts: DataFrame, bindings: DataFrame, authorities: DataFrame, *, source: int, scale: int, cell: int = 365 * DAY) -> DataFrame:
    """(receipt_id, inst, ts_ns, px) of wire events, one object or an array of them.

    bindings: symbol, inst, from_ns, to_ns; authorities: inst, source, from_ns,
    to_ns.  A value counts when its symbol is bound at its time, ``source`` has
    the authority over the instrument then, and it has an exact scaled form.
    """
    many = F.coalesce(F.from_json("payload", f"array<{WIRE}>"), F.array(F.from_json("payload", WIRE)))
    events = receipts.select("receipt_id", F.explode(many).alias("e")).where(F.try_element_at("e", F.lit("ev")) == "V")
    of = lambda k: F.try_element_at("e", F.lit(k))
    events = events.select("receipt_id", of("T").alias("symbol"), F.try_multiply(of("t").try_cast("long"), F.lit(1_000_000)).alias("ts_ns"), scalars.scale_exact(of("val").try_cast("double"), scale).alias("px"))
    bound = joins.interval_join(events.where(F.col("px").isNotNull()), bindings, on=["symbol"], at="ts_ns", start="from_ns", end="to_ns", cell=cell)
    bound = bound.select("receipt_id", "symbol", "inst", "ts_ns", "px")
    mine = authorities.where(F.col("source") == source)
    return joins.interval_join(bound, mine, on=["inst"], at="ts_ns", start="from_ns", end="to_ns", cell=cell).select("receipt_id", "inst", "ts_ns", "px")


def snapshots(receipts: DataFrame, manifest: DataFrame, *, scale: int) -> DataFrame:
    """(refresh_id, inst, ts_ns, px, live) of the refreshes that are complete.

    receipts: refresh_id, receipt_id, status_code, payload; a refresh may come
    in several receipts.  manifest: ticker, inst, recency.  One bad receipt or
    record, a ticker that is missing, unknown or there twice, and a recency
    other than the manifest's refuse the whole refresh.
    """
    parsed = receipts.select("refresh_id", "receipt_id", "status_code", F.from_json("payload", SNAPSHOT).alias("p"))
    good = F.coalesce((F.col("status_code") == 200) & (F.col("p.status") == "OK") & F.col("p.results").isNotNull(), F.lit(False))
    records = parsed.select("refresh_id", good.alias("good"), F.explode_outer("p.results").alias("r")).select("refresh_id", "good", "r.*")
    known = manifest.select("ticker", "inst", "recency")
    rows = records.join(known, "ticker", "left")
    px = scalars.scale_exact(F.col("value"), scale)
    sound = F.col("good") & F.col("error").isNull() & F.col("inst").isNotNull() & (F.col("type") == "indices") & (F.col("timeframe") == F.col("recency")) & (F.col("last_updated") > 0) & px.isNotNull()
    rows = rows.select("refresh_id", "ticker", "inst", F.col("last_updated").alias("ts_ns"), px.alias("px"), (F.col("timeframe") == "REAL-TIME").alias("live"), F.coalesce(sound, F.lit(False)).alias("sound"))
    wanted = known.agg(F.count(F.lit(1)).alias("wanted"))  # one row
    whole = rows.groupBy("refresh_id").agg(F.bool_and("sound").alias("all_sound"), F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"))
    whole = whole.join(F.broadcast(wanted)).where("all_sound and n = wanted and tickers = wanted").select("refresh_id")
    return rows.join(whole, "refresh_id", "left_semi").select("refresh_id", "inst", "ts_ns", "px", "live")


def catalogue_violations(catalogue: DataFrame) -> DataFrame:
    """(rule, ticker) for every row of inst, ticker, scale, from_ns, to_ns that breaks a rule."""
    again = Window.partitionBy("ticker").orderBy("from_ns", "to_ns").rowsBetween(Window.unboundedPreceding, -1)
    rules = F.array(
        F.when(~F.coalesce(F.col("ticker").rlike(r"\AI:[A-Z0-9_]+\z"), F.lit(False)), F.lit("ticker")),
        F.when(F.coalesce(F.col("scale"), F.lit(0)) <= 0, F.lit("scale")),
        F.when(F.coalesce(F.col("inst"), F.lit(0)) <= 0, F.lit("instrument")),
        F.when(F.col("from_ns") >= F.col("to_ns"), F.lit("time order")),
        F.when(F.col("until") > F.col("from_ns"), F.lit("overlap")),
    )
    return catalogue.withColumn("until", F.max("to_ns").over(again)).select("ticker", F.explode(F.array_compact(rules)).alias("rule"))
