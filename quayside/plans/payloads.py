"""Queries of the decoders: payloads as providers write them, made from the given tables by Spark, and what must come of them in SQL.

A receipt holds the months of one customer's orders.  By the number of the
receipt some are spoilt: 0 of 10 bring a period twice, 1 a word for a number, 2
mark the first month of each year as missing; 3 spoil what is special to the
provider.  ``observed`` is what a sound decoder makes of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import venue_ledger
from quayside.plans.views import view
from quayside.sources import decoders, documents, index_values, venue

MONTHS = "select o_custkey as receipt_id, year(o_orderdate) as y, month(o_orderdate) as m, cast(sum(cast(round(o_totalprice) as bigint)) as bigint) as v from @table(orders) group by 1, 2, 3"
FINE = "receipt_id % 10 not in (0, 1, 3)"
#: What a decoder that skips missing months must give, and one of a provider without a mark for them.
OBSERVED = f", observed as (select receipt_id, cast(make_date(cast(y as integer), cast(m as integer), 1) as varchar) as period_start, cast(v as double) as value, m from ({MONTHS}) x where {FINE} and (receipt_id % 10 <> 2 or m <> 1))"
ALL_OBSERVED = OBSERVED.replace(" and (receipt_id % 10 <> 2 or m <> 1)", "")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id, fault, xs): xs are the months of a receipt in order: y, m, v (text), first spoilt where the receipt is."""
    months = view(spark, sf_dir, MONTHS).select("receipt_id", F.struct(F.col("y").cast("int").alias("y"), F.col("m").cast("int").alias("m"), F.col("v").cast("string").alias("v")).alias("x"))
    listed = months.groupBy("receipt_id").agg(F.sort_array(F.collect_list("x")).alias("xs")).withColumn("fault", (F.col("receipt_id") % 10).cast("int"))
    spoilt = lambda x, i: F.when((F.col("fault") == 1) & (i == 0), x.withField("v", F.lit("oops"))).otherwise(x)
    rows = listed.withColumn("xs", F.transform("xs", spoilt))
    return rows.withColumn("xs", F.when(F.col("fault") == 0, F.concat("xs", F.slice("xs", 1, 1))).otherwise(F.col("xs")))


def _value(x: Column, missing: str) -> Column:
    return F.when((F.col("fault") == 2) & (x["m"] == 1), F.lit(missing)).otherwise(x["v"])


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _receipts(rows: DataFrame, payload: Column) -> DataFrame:
    return rows.select("receipt_id", payload.alias("payload"))


def _dated(found: DataFrame) -> DataFrame:
    """Days as text, which all engines write alike."""
    return found.withColumn("period_start", F.col("period_start").cast("string"))


def _labour(rows: DataFrame) -> DataFrame:
    notes = lambda x: F.array(F.struct(F.when(x["m"] % 2 == 0, F.lit("P")).otherwise(F.lit("")).alias("code")))
    months = F.transform("xs", lambda x: F.struct(x["y"].cast("string").alias("year"), F.concat(F.lit("M"), _two(x["m"])).alias("period"), _value(x, "-").alias("value"), notes(x).alias("footnotes")))
    year = F.array(F.struct(F.lit("1999").alias("year"), F.lit("M13").alias("period"), F.lit("1").alias("value"), F.array(F.struct(F.lit("").alias("code"))).alias("footnotes")))
    series = F.struct(F.concat(F.lit("S"), F.col("receipt_id").cast("string")).alias("seriesID"), F.concat(F.reverse(months), year).alias("data"))
    return _receipts(rows, F.to_json(F.struct(F.struct(F.when(F.col("fault") == 3, F.array(series, series)).otherwise(F.array(series)).alias("series")).alias("Results"))))


def _rates(rows: DataFrame) -> DataFrame:
    days = F.transform("xs", lambda x: F.struct(F.concat_ws("-", x["y"].cast("string"), _two(x["m"]), F.lit("01")).alias("date"), _value(x, ".").alias("value")))
    return _receipts(rows, F.to_json(F.struct(F.when(F.col("fault") == 3, "pch").otherwise("lin").alias("units"), F.lit(1).alias("output_type"), days.alias("observations"))))


def _accounts(rows: DataFrame) -> DataFrame:
    cell = lambda table, line, period, value: F.struct(F.lit(table).alias("TableName"), F.lit(line).alias("LineNumber"), period.alias("TimePeriod"), F.when(F.col("fault") == 3, "Index").otherwise("Level").alias("CL_UNIT"), value.alias("DataValue"))
    label = lambda x: F.concat(x["y"].cast("string"), F.lit("M"), _two(x["m"]))
    parted = lambda v: F.regexp_replace(v, r"(?<=\d)(?=(\d{3})+$)", ",")
    data = F.concat(F.transform("xs", lambda x: cell("T10101", "1", label(x), parted(x["v"]))), F.transform("xs", lambda x: cell("T10101", "2", label(x), F.lit("7"))))
    return _receipts(rows, F.to_json(F.struct(F.struct(F.struct(data.alias("Data")).alias("Results")).alias("BEAAPI"))))


def _cube(rows: DataFrame) -> DataFrame:
    """A cube cannot bring a period twice or a word; those receipts name another version and another class."""
    key = lambda x: F.concat(x["y"].cast("string"), F.lit("-"), _two(x["m"]))
    rows = rows.withColumn("whole", F.filter("xs", lambda x: x["v"] != "oops")).withColumn("keys", F.array_distinct(F.transform("whole", key)))
    n = F.size("keys")
    index = F.map_from_entries(F.transform("keys", lambda k, i: F.struct(k, i)))
    numbered = F.transform(F.slice("whole", F.lit(1), n), lambda x, i: F.struct(i.cast("string").alias("i"), x.alias("x")))
    pairs = F.filter(numbered, lambda p: ~((F.col("fault") == 2) & (p["x"]["m"] == 1)))
    cube = F.struct(
        F.when(F.col("fault") == 0, "1.0").otherwise("2.0").alias("version"), F.when(F.col("fault") == 1, "collection").otherwise("dataset").alias("class"), F.array(F.lit("geo"), F.lit("time")).alias("id"),
        F.array(F.when(F.col("fault") == 3, 2).otherwise(1), n).alias("size"), F.struct(F.struct(F.struct(index.alias("index")).alias("category")).alias("time")).alias("dimension"),
        F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["i"], p["x"]["v"].cast("double")))).alias("value"),
        F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["x"]["m"] % 2 == 0), lambda p: F.struct(p["i"], F.lit("e")))).alias("status"),
    )
    return _receipts(rows.where(n > 0), F.to_json(cube))


def _arrays(rows: DataFrame) -> DataFrame:
    """Values are numbers here: a word becomes a day that does not exist."""
    day = lambda x: F.when(x["v"] == "oops", F.lit(20_240_230)).otherwise(x["y"] * 10_000 + x["m"] * 100 + 1).cast("long")
    number = lambda x: F.when((F.col("fault") == 2) & (x["m"] == 1), F.lit(None)).when(x["v"] == "oops", F.lit("1")).otherwise(x["v"]).cast("double")
    values = F.struct(F.transform("xs", day).alias("SURVEY_DATES"), F.transform("xs", number).alias("VALUES"))
    payload = F.struct(F.lit(200).alias("STATUS"), F.when(F.col("fault") == 3, "2").alias("NEXTPOSITION"), F.array(F.struct(F.lit("CALL").alias("SERIES_CODE"), values.alias("VALUES"))).alias("RESULTSET"))
    return _receipts(rows, F.to_json(payload, {"ignoreNullFields": "false"}))


_KEY = "FM.D.U2.EUR.4F.KR.DFR.LEV"


def _lines(rows: DataFrame, head: str, line, spoilt_head: str, end: str = "\n") -> DataFrame:
    return _receipts(rows, F.concat(F.when(F.col("fault") == 3, spoilt_head).otherwise(head), F.lit(end), F.array_join(F.transform("xs", line), end), F.lit(end)))


def _policy(rows: DataFrame) -> DataFrame:
    return _lines(rows, documents.RATE_HEADER, lambda x: F.concat(F.lit(_KEY + "," + ",".join(_KEY.split(".")[1:]) + ","), x["y"].cast("string"), F.lit("-"), _two(x["m"]), F.lit("-01,"), x["v"]), "KEY,VALUE")


def _bank(rows: DataFrame) -> DataFrame:
    named = lambda x: F.date_format(F.make_date(x["y"], x["m"], F.lit(1)), "dd MMM yyyy")
    return _lines(rows, "DATE,ABC", lambda x: F.concat(named(x), F.lit(","), x["v"]), "DATE,XYZ", "\r\n")


def _office_statistics(rows: DataFrame) -> DataFrame:
    named = lambda x: F.upper(F.date_format(F.make_date(x["y"], x["m"], F.lit(1)), "yyyy MMM"))
    facts = '"Title","T"\n"CDID","%s"\n"Release date","22-07-2026"\n"2025","3.4"\n"2026 Q1","1.5"'
    return _lines(rows, facts % "AB12", lambda x: F.concat(F.lit('"'), named(x), F.lit('","'), x["v"], F.lit('"')), facts % "ZZ99")


def _census(rows: DataFrame) -> DataFrame:
    cells = lambda x: F.array(x["v"], F.when(F.col("fault") == 3, "XX").otherwise("SM"), F.concat(x["y"].cast("string"), F.lit("-"), _two(x["m"])))
    return _receipts(rows, F.to_json(F.concat(F.array(F.array(F.lit("cell_value"), F.lit("kind"), F.lit("time"))), F.transform("xs", cells))))


def decoded_labour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(decoders.labour_series(_labour(_listed(spark, sf_dir))))


def decoded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(decoders.daily_rates(_rates(_listed(spark, sf_dir)), "DGS").select("receipt_id", "period_start", "value"))


def decoded_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(decoders.national_accounts(_accounts(_listed(spark, sf_dir)), "T10101", "1", "Level").select("receipt_id", "period_start", "value"))


def decoded_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(decoders.stat_cube(_cube(_listed(spark, sf_dir)), "hicp").select("receipt_id", "period_start", "value", "provisional"))


def decoded_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(decoders.parallel_arrays(_arrays(_listed(spark, sf_dir))).select("receipt_id", "period_start", "value"))


def decoded_policy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(documents.policy_rate_csv(_policy(_listed(spark, sf_dir)), _KEY).select("receipt_id", "period_start", "value"))


def decoded_bank_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(documents.bank_rate_csv(_bank(_listed(spark, sf_dir)), "ABC").select("receipt_id", "period_start", "value"))


def decoded_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(documents.statistics_csv(_office_statistics(_listed(spark, sf_dir)), "AB12").select("receipt_id", "period_start", "value"))


def decoded_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(documents.header_first(_census(_listed(spark, sf_dir)), {"kind": "SM"}).select("receipt_id", "period_start", "value"))


def decode_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of decoders over receipts of all its streams: how many were refused, records and events."""
    rows = _listed(spark, sf_dir)
    made = {"labour": _labour(rows), "rates": _rates(rows), "accounts": _accounts(rows), "arrays": _arrays(rows)}
    every = None
    for stream, r in made.items():
        r = r.select(F.lit(stream).alias("stream"), "receipt_id", "payload")
        every = r if every is None else every.unionByName(r)
    used = {s: d for s, d in decoders.DECODERS.items() if s in made}
    return decoders.statistics(every, decoders.decode(every, used), used)


def decoded_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four-minute bars of a session as one receipt; a session in eleven has a wrong count, one in thirteen a bar twice."""
    bars = view(spark, sf_dir, "select inst, s_open, open_ns, o, h, l, c from m4")
    one = F.struct(*[(F.col(c) / 100).alias(c) for c in "ohlc"], F.expr("open_ns div 1000000").alias("t"))
    listed = bars.groupBy("inst", "s_open").agg(F.collect_list(one).alias("bs")).withColumn("day", F.expr("s_open div 86400000000000"))
    bs = F.when(F.col("day") % 13 == 0, F.concat("bs", F.slice("bs", 1, 1))).otherwise(F.col("bs"))
    payload = F.to_json(F.struct(F.concat(F.lit("I:X"), F.col("inst").cast("string")).alias("ticker"), (F.size(bs) + F.when(F.col("day") % 11 == 0, 1).otherwise(0)).alias("resultsCount"), bs.alias("results")))
    receipts = listed.select((F.col("inst") * 100_000 + F.col("day")).alias("receipt_id"), payload.alias("payload"))
    return decoders.aggregate_bars(receipts, 100).select("ticker", "open_ns", "o", "h", "l", "c")


MARKETS = {f"{i}+": i for i in range(4)}


def decoded_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly reports with every market; a report in nine lacks one, one in seven has a group with a gap."""
    rows = view(spark, sf_dir, "select distinct report_date from reports").withColumn("market", F.explode(F.array(*map(F.lit, range(4)))))
    rows = rows.where(~((F.col("report_date") % 9 == 0) & (F.col("market") == 3)))
    names = [c for p in documents.PARTICIPANTS for c in p[1:] if c]
    counts = [F.when((F.col("report_date") % 7 == 0) & (F.lit(i) == 4), F.lit(None)).otherwise(F.col("report_date") % 1000 + F.col("market") * 10 + i).cast("string").alias(c) for i, c in enumerate(names)]
    day = F.concat(F.expr("cast(report_date div 12 as string)"), F.lit("-"), _two(F.col("report_date") % 12 + 1), F.lit("-02T00:00:00.000"))
    record = F.struct(
        F.concat_ws("-", F.col("report_date").cast("string"), F.col("market").cast("string")).alias("id"), day.alias("report_date_as_yyyy_mm_dd"), F.concat(F.col("market").cast("string"), F.lit("+")).alias("cftc_contract_market_code"),
        F.lit("500").alias("open_interest_all"), *counts,
    )
    receipts = rows.groupBy(F.col("report_date").alias("receipt_id")).agg(F.to_json(F.collect_list(record), {"ignoreNullFields": "false"}).alias("payload"))
    return documents.positioning(receipts, MARKETS).select("receipt_id", "inst", "participant", "long_q", "short_q", "spread_q")


def decoded_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar for each user of the events of a few hours, half of them releases; times in winter, US Eastern; one user in nine has an event without a title."""
    events = view(spark, sf_dir, "select seq, user_id, ts_ns, case when seq % 2 = 0 then 'Consumer Prices' when seq % 4 = 1 then 'Payrolls' else 'Other' end as title from ticks where k < 20")
    local = F.date_format(F.timestamp_seconds(F.expr("ts_ns div 1000000000")), "yyyyMMdd'T'HHmmss")
    title = F.when((F.col("user_id") % 9 == 0) & (F.col("seq") % 3 == 0), F.lit("")).otherwise(F.col("title"))
    block = F.concat(F.lit("BEGIN:VEVENT\r\nUID:u"), F.col("seq").cast("string"), F.lit("\r\nDTSTART;TZID=America/New_York:"), local, F.lit("\r\nSUMMARY:"), title, F.lit("\r\nEND:VEVENT\r\n"))
    receipts = events.groupBy(F.col("user_id").alias("receipt_id")).agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.collect_list(block), ""), F.lit("END:VCALENDAR\r\n")).alias("payload"))
    found = documents.release_calendar(receipts, {"Consumer Prices": "cpi", "Payrolls": "jobs"})
    return found.select("receipt_id", "uid", "release", F.unix_seconds("scheduled").alias("scheduled_s"))


def wire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire events, one or three in a payload, with symbols that change their instrument in mid-January and an authority that does so later."""
    events = view(spark, sf_dir, "select seq, inst, @div(ts_ns, 1000000) as ms, px from ticks")
    wire = F.struct(F.when(F.col("seq") % 7 == 0, "AM").otherwise("V").alias("ev"), (F.col("px") / 100).cast("string").alias("val"), F.concat(F.lit("I:"), F.col("inst").cast("string")).alias("T"), F.col("ms").cast("string").alias("t"))
    payload = F.when(F.col("seq") % 3 == 0, F.to_json(F.array(wire, wire, wire))).otherwise(F.to_json(wire))
    receipts = events.select(F.col("seq").alias("receipt_id"), payload.alias("payload"))
    change, later, end = 1_705_276_800_000_000_000, 1_705_881_600_000_000_000, 1_800_000_000_000_000_000
    bindings = spark.range(1, 7).select(F.concat(F.lit("I:"), F.col("id").cast("string")).alias("symbol"), F.inline(F.array(F.struct(F.col("id").alias("inst"), F.lit(0).alias("from_ns"), F.lit(change).alias("to_ns")), F.struct((F.col("id") + 10).alias("inst"), F.lit(change).alias("from_ns"), F.lit(end).alias("to_ns")))))
    authorities = spark.range(1, 17).select(F.col("id").alias("inst"), F.lit(5).alias("source"), F.lit(0).cast("long").alias("from_ns"), F.when(F.col("id") % 2 == 0, F.lit(end)).otherwise(F.lit(later)).alias("to_ns"))
    return index_values.wire_values(receipts, bindings, authorities, source=5, scale=100).select("receipt_id", "inst", "ts_ns", "px")


def snapshot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh for each order: three tickers in two receipts; a refresh in five lacks one, one in seven has an error, one in eleven another recency."""
    orders = view(spark, sf_dir, "select o_orderkey as refresh_id, cast(round(o_totalprice * 100) as bigint) as px, @micros(o_orderdate) * 1000 as ts_ns from @table(orders)")
    r = F.col("refresh_id")
    result = lambda i: F.struct(
        F.concat(F.lit("I:T"), F.lit(str(i))).alias("ticker"), F.lit("indices").alias("type"), F.when((r % 11 == 0) & (F.lit(i) == 1), "DELAYED").otherwise("REAL-TIME").alias("timeframe"), (F.col("ts_ns") + i).alias("last_updated"),
        ((F.col("px") + i) / 100).alias("value"), F.when((r % 7 == 0) & (F.lit(i) == 2), "NOT_FOUND").alias("error"),
    )
    second = F.when(r % 5 == 0, F.array(result(1))).otherwise(F.array(result(1), result(2)))
    parts = orders.select("refresh_id", F.posexplode(F.array(F.array(result(0)), second)).alias("part", "results"))
    receipts = parts.select("refresh_id", (F.col("refresh_id") * 2 + F.col("part")).alias("receipt_id"), F.lit(200).alias("status_code"), F.to_json(F.struct(F.lit("OK").alias("status"), "results")).alias("payload"))
    manifest = spark.range(3).select(F.concat(F.lit("I:T"), F.col("id").cast("string")).alias("ticker"), F.col("id").alias("inst"), F.lit("REAL-TIME").alias("recency"))
    return index_values.snapshots(receipts, manifest, scale=100).select("refresh_id", "inst", "ts_ns", "px")


def catalogue_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "select case when p_partkey % 8 = 0 then 'x' else concat('I:P', cast(@div(p_partkey, 3) as varchar(12))) end as ticker, p_size % 40 as scale, p_partkey % 90 as inst, p_partkey % 50 as from_ns, p_partkey % 50 + p_size % 9 as to_ns, p_partkey from @table(part)")
    return index_values.catalogue_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_BINDINGS = {"DE30": (4, 100), "OIL": (6, 1_000)}


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account epoch for each customer: orders are its orders, positions and executions are made of their numbers; columns come in an order of the customer's own."""
    orders = view(spark, sf_dir, "select o_custkey as epoch_id, o_orderkey, cast(round(o_totalprice) as bigint) as px, @micros(o_orderdate) as us, o_orderstatus from @table(orders)")
    k, inst = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, 77).when(F.col("o_orderkey") % 2 == 0, 31).otherwise(58)
    text = lambda c: c.cast("string")
    ms = F.expr("us div 1000")
    turned = F.col("epoch_id") % 2 == 1

    def cells(values: dict[str, Column], names: tuple[str, ...]) -> Column:
        row = F.array(*[text(values[n]) for n in names])
        return F.when(turned, F.reverse(row)).otherwise(row)

    side = F.when(k % 3 == 0, "buy").otherwise("sell")
    order = {"id": k, "tradableInstrumentId": inst, "side": side, "type": F.lit("limit"), "status": F.lit("New"), "qty": k % 7 + 1, "filledQty": F.lit(0), "avgPrice": F.col("px"), "createdDate": ms, "isOpen": F.lit("true")}
    position = {"id": k + 1, "tradableInstrumentId": inst, "side": side, "qty": k % 7 + 1, "avgPrice": F.col("px"), "unrealizedPl": k % 11 - 5, "openDate": ms}
    fill = {"id": k + 2, "tradableInstrumentId": inst, "orderId": k, "positionId": k + 1, "side": side, "qty": k % 7 + 1, "price": F.col("px"), "createdDate": ms + 1}
    by = {name: needed for name, (_, _, needed) in venue.TABLES.items()}
    listed = orders.groupBy("epoch_id").agg(
        F.collect_list(F.when(F.col("o_orderstatus") == "O", cells(order, by["orders"]))).alias("open"), F.collect_list(F.when(F.col("o_orderstatus") == "F", cells(order, by["order_history"]))).alias("done"),
        F.collect_list(F.when(F.col("o_orderstatus") == "P", cells(position, by["positions"]))).alias("held"), F.collect_list(F.when(k % 4 == 0, cells(fill, by["executions"]))).alias("filled"),
    )
    e = F.col("epoch_id")
    layouts = {"accountDetailsConfig": venue.ACCOUNT} | {layout: needed for layout, _, needed in venue.TABLES.values()}
    names = lambda ns: F.when(turned, F.reverse(F.array(*map(F.lit, ns)))).otherwise(F.array(*map(F.lit, ns)))
    config = F.struct(*[F.struct(F.transform(names(ns) if layout != "accountDetailsConfig" else F.array(*map(F.lit, ns)), lambda n: F.struct(n.alias("id"))).alias("columns")).alias(layout) for layout, ns in layouts.items()])
    reply = lambda body, ok=None: F.to_json(F.struct((F.lit("ok") if ok is None else ok).alias("s"), body.alias("d")))
    routes = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("type")) for i, t in (("5", "INFO"), ("6", "TRADE"))])
    instruments = F.array(*[F.struct(F.lit(i).alias("tradableInstrumentId"), F.lit(n).alias("name"), routes.alias("routes")) for i, n in ((31, "DE30"), (58, "OIL"), (77, "WHEAT"))])
    money = F.array(*[(e % 1000 + i).cast("double") for i in range(6)])
    detail = F.struct(F.lit(12).alias("sessionId"), F.lit(0.1).alias("minQty"), F.lit(0.1).alias("qtyStep"), F.lit(0.5).alias("priceIncrement"), F.lit(True).alias("tradable"))
    quote = F.struct((e % 100 + 10).cast("double").alias("bp"), (e % 100 + 10 + F.when(e % 13 == 0, -1).otherwise(1)).cast("double").alias("ap"))
    pair = lambda i, body: F.struct(F.lit(i).cast("long").alias("id"), reply(body).alias("payload"))
    quotes = F.when(e % 11 == 0, F.array(pair(31, quote))).otherwise(F.array(pair(31, quote), pair(58, quote)))
    return listed.select(
        "epoch_id", e.alias("account_id"), F.lit(1_000).cast("long").alias("started_ns"), F.when(e % 17 == 0, 500).otherwise(2_000).cast("long").alias("received_ns"), reply(config).alias("config"), reply(F.struct(instruments.alias("instruments"))).alias("instruments"),
        reply(F.struct(money.alias("accountDetailsData"))).alias("account_state"), reply(F.struct(F.col("held").alias("positions")), F.when(e % 19 == 0, "late").otherwise("ok")).alias("positions"), reply(F.struct(F.col("open").alias("orders"))).alias("orders"),
        reply(F.struct(F.col("done").alias("ordersHistory"))).alias("order_history"), reply(F.struct(F.col("filled").alias("executions"))).alias("executions"), F.array(pair(31, detail), pair(58, detail)).alias("details"), quotes.alias("quotes"),
    )


def venue_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each epoch was refused for, else what it holds of the bound instruments."""
    out = venue.decode(_epochs(spark, sf_dir), _BINDINGS)
    n = lambda c: F.coalesce(F.when(F.col("rejected").isNull(), F.size(c)), F.lit(0)).cast("long").alias(f"n_{c}")
    return out.select("epoch_id", "rejected", *[n(c) for c in ("positions", "orders", "order_history", "executions")], F.col("account.balance").alias("balance"), F.get("quotes", F.lit(0))["mid"].alias("first_mid"))


def venue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries of all epochs by kind and status, appended once."""
    decoded = venue.decode(_epochs(spark, sf_dir), _BINDINGS)
    known = view(spark, sf_dir, "select o_custkey as account_id, o_orderkey as id from @table(orders) where o_orderkey % 6 <> 0")
    made = venue_ledger.entries(decoded, venue.unknown_objects(decoded, known, "orders"))
    old = made.where((F.col("kind") == "fill") & (F.col("epoch_id") % 3 == 0))
    fresh = venue_ledger.append_once(old, made)
    return fresh.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_ns").cast("decimal(20,0)")).cast("string").alias("sum_event_ns"))


def venue_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = venue.decode(_epochs(spark, sf_dir), _BINDINGS)
    nothing = decoded.select("epoch_id", F.lit(0).cast("long").alias("id")).limit(0)
    return venue_ledger.entries(decoded, nothing).where("kind = 'order'").select("epoch_id", "inst", "body")


def reconciled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of an epoch (a customer) after the fills that name a known order; each fill counts once."""
    orders = view(spark, sf_dir, "select o_custkey as epoch, o_orderkey as ordinal, o_orderkey as order_id, case o_orderstatus when 'O' then 'working' else 'cancelled' end as status, cast(0 as bigint) as filled, cast(null as bigint) as position_id from @table(orders)")
    fills = view(spark, sf_dir, "select o_custkey as epoch, l_orderkey * 8 + l_linenumber as fill_id, case when l_linenumber = 7 then -1 else l_orderkey end as order_id, cast(l_linenumber as bigint) as position_id, cast(round(l_quantity * 1000) as bigint) as qty, l_partkey * 100000 + l_suppkey as ordinal from @table(lineitem) l join @table(orders) o on l.l_orderkey = o.o_orderkey")
    once = fills.groupBy("epoch", "fill_id", "order_id", "position_id").agg(F.min(F.struct("ordinal", "qty")).alias("f")).select("epoch", "f.ordinal", "fill_id", "order_id", "position_id", "f.qty")
    return venue_ledger.order_states(orders, once).select("epoch", "order_id", "status", "filled")


def reconciliation_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = view(spark, sf_dir, "select cast(user_id % 7 as varchar(4)) as stream, seq as ordinal, @div(seq, 40) as epoch, case when seq % 3 = 0 then 'finish' else 'begin' end as kind from ticks where k < 40")
    intents = view(spark, sf_dir, "select cast(user_id % 7 as varchar(4)) as stream, seq as ordinal, k as intent_id, case when seq % 4 = 0 then 'unknown' else 'resolved' end as kind from ticks where k >= 40")
    return venue_ledger.epoch_states(marks, intents)


QUERIES = {
    f.__name__: f
    for f in (
        decoded_labour, decoded_rates, decoded_accounts, decoded_cube, decoded_arrays, decoded_policy_rates, decoded_bank_rates, decoded_statistics, decoded_census, decode_statistics, decoded_bars, decoded_positioning, decoded_calendar,
        wire_values, snapshot_values, catalogue_faults, venue_epochs, venue_entries, venue_bodies, reconciled_orders, reconciliation_epochs,
    )
}

_POINTS = "select receipt_id, period_start, value from observed"
_LONG = [(n, i) for n, i in zip(("dealer", "asset_manager", "leveraged", "other", "nonreportable"), (0, 3, 6, 9, 12), strict=True)]
_REFUSED = "case when o_custkey % 17 = 0 then 'times' when o_custkey % 11 = 0 or o_custkey % 13 = 0 then 'quotes' when o_custkey % 19 = 0 then 'positions' end"
_FINE_EPOCH = "o_custkey % 17 <> 0 and o_custkey % 11 <> 0 and o_custkey % 13 <> 0 and o_custkey % 19 <> 0"
_SIDE = "case when o_orderkey % 3 = 0 then 'BUY' else 'SELL' end"

ORACLES = {
    "decoded_labour": OBSERVED + " select receipt_id, concat('S', receipt_id) as series, period_start, value, m % 2 = 0 as provisional from observed",
    **dict.fromkeys(("decoded_rates", "decoded_arrays"), OBSERVED + _POINTS.replace("select", " select", 1)),
    "decoded_cube": OBSERVED + " select receipt_id, period_start, value, m % 2 = 0 as provisional from observed",
    **dict.fromkeys(("decoded_accounts", "decoded_policy_rates", "decoded_bank_rates", "decoded_statistics", "decoded_census"), ALL_OBSERVED + _POINTS.replace("select", " select", 1)),
    "decode_statistics": f"""
        , months as ({MONTHS}), sizes as (select receipt_id, receipt_id % 10 as fault, count(*) as n, count(*) filter (where receipt_id % 10 <> 2 or m <> 1) as kept from months group by receipt_id)
        select stream, count(*) as receipts, count(*) filter (where fault in (0, 1) or (fault = 3 and stream <> 'accounts') or (case when stream = 'accounts' then n else kept end) = 0) as refused,
        cast(sum((n + case when fault = 0 then 1 else 0 end) * case stream when 'accounts' then 2 else 1 end + case stream when 'labour' then 1 else 0 end) as bigint) as records,
        cast(sum(case when fault in (0, 1) or (fault = 3 and stream <> 'accounts') then 0 when stream = 'accounts' then n else kept end) as bigint) as events
        from sizes cross join (select unnest(['labour', 'rates', 'accounts', 'arrays']) as stream) s group by stream""",
    "decoded_bars": "select concat('I:X', inst) as ticker, open_ns, o, h, l, c from m4 where (s_open // 86400000000000) % 13 <> 0 and (s_open // 86400000000000) % 11 <> 0",
    "decoded_positioning": f"""
        , dates as (select distinct report_date from reports where report_date % 9 <> 0 and report_date % 7 <> 0)
        select report_date as receipt_id, cast(market as integer) as inst, p.name as participant, report_date % 1000 + market * 10 + p.i as long_q, report_date % 1000 + market * 10 + p.i + 1 as short_q, case when p.i = 12 then 0 else report_date % 1000 + market * 10 + p.i + 2 end as spread_q
        from dates cross join (select unnest([0, 1, 2, 3]) as market) m cross join (values {', '.join(f"('{n}', {i})" for n, i in _LONG)}) p(name, i)""",
    "decoded_calendar": """
        , e as (select seq, user_id, ts_ns from ticks where k < 20), bad as (select distinct user_id from e where user_id % 9 = 0 and seq % 3 = 0)
        select user_id as receipt_id, concat('u', seq) as uid, case when seq % 2 = 0 then 'cpi' else 'jobs' end as release, ts_ns // 1000000000 + 18000 as scheduled_s from e where user_id not in (select user_id from bad) and seq % 4 <> 3""",
    "wire_values": """
        , e as (select seq, inst + case when ts_ns >= 1705276800000000000 then 10 else 0 end as inst, ts_ns // 1000000 * 1000000 as ts_ns, px from ticks where seq % 7 <> 0)
        select seq as receipt_id, inst, ts_ns, px from e cross join (select unnest([1, 2, 3]) as copy) c where (copy = 1 or seq % 3 = 0) and (inst % 2 = 0 or ts_ns < 1705881600000000000)""",
    "snapshot_values": """
        select o_orderkey as refresh_id, i as inst, epoch_us(o_orderdate) * 1000 + i as ts_ns, cast(round(o_totalprice * 100) as bigint) + i as px from orders cross join (select unnest([0, 1, 2]) as i) t where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0""",
    "catalogue_faults": """
        , rows_of as (select case when p_partkey % 8 = 0 then 'x' else concat('I:P', p_partkey // 3) end as ticker, p_size % 40 as scale, p_partkey % 90 as inst, p_partkey % 50 as f, p_partkey % 50 + p_size % 9 as t from part),
        seen as (select *, max(t) over (partition by ticker order by f, t rows between unbounded preceding and 1 preceding) as until from rows_of)
        select rule, count(*) as n from (select unnest([case when not regexp_full_match(ticker, 'I:[A-Z0-9_]+') then 'ticker' end, case when scale <= 0 then 'scale' end, case when inst <= 0 then 'instrument' end, case when f >= t then 'time order' end, case when until > f then 'overlap' end]) as rule from seen) x where rule is not null group by rule""",
    "venue_epochs": f"""
        select o_custkey as epoch_id, {_REFUSED} as rejected, cast(case when {_FINE_EPOCH} then count(*) filter (where o_orderstatus = 'P' and o_orderkey % 5 <> 0) else 0 end as bigint) as n_positions,
        cast(case when {_FINE_EPOCH} then count(*) filter (where o_orderstatus = 'O' and o_orderkey % 5 <> 0) else 0 end as bigint) as n_orders, cast(case when {_FINE_EPOCH} then count(*) filter (where o_orderstatus = 'F' and o_orderkey % 5 <> 0) else 0 end as bigint) as n_order_history,
        cast(case when {_FINE_EPOCH} then count(*) filter (where o_orderkey % 4 = 0 and o_orderkey % 5 <> 0) else 0 end as bigint) as n_executions, case when {_FINE_EPOCH} then (o_custkey % 1000) * 1000000 end as balance,
        case when {_FINE_EPOCH} then ((o_custkey % 100 + 10) * 100 + (o_custkey % 100 + 11) * 100) // 2 end as first_mid from orders group by o_custkey""",
    "venue_entries": f"""
        , fine as (select * from orders where {_FINE_EPOCH}), mine as (select *, epoch_us(o_orderdate) // 1000 * 1000000 as ns from fine where o_orderkey % 5 <> 0),
        strange as (select distinct o_custkey from mine where o_orderstatus = 'O' and o_orderkey % 6 = 0),
        made as (select 'reconciliation' as kind, case when o_custkey in (select o_custkey from strange) then 'incident' else 'accepted' end as status, cast(2000 as bigint) as ns from (select distinct o_custkey from fine) e
        union all select 'order', case o_orderstatus when 'O' then 'pending' when 'F' then 'pending' end, ns from mine where o_orderstatus in ('O', 'F')
        union all select 'position', 'observed', ns from mine where o_orderstatus = 'P' union all select 'fill', 'accepted', ns + 1000000 from mine where o_orderkey % 4 = 0 and o_custkey % 3 <> 0)
        select kind, status, count(*) as n, cast(sum(cast(ns as hugeint)) as varchar) as sum_event_ns from made group by kind, status""",
    "venue_bodies": f"""
        select o_custkey as epoch_id, case when o_orderkey % 2 = 0 then 4 else 6 end as inst, printf('Venue order %d %s %.6f limit @ %.5f / status New.', o_orderkey, {_SIDE}, cast(o_orderkey % 7 + 1 as double), cast(cast(round(o_totalprice) as bigint) as double)) as body
        from orders where {_FINE_EPOCH} and o_orderkey % 5 <> 0 and o_orderstatus in ('O', 'F')""",
    "reconciled_orders": """
        , once as (select l_orderkey, l_linenumber, arg_min(cast(round(l_quantity * 1000) as bigint), (l_partkey * 100000 + l_suppkey, cast(round(l_quantity * 1000) as bigint))) as qty from lineitem where l_linenumber <> 7 group by l_orderkey, l_linenumber),
        filled as (select l_orderkey, sum(qty) as qty from once group by l_orderkey)
        select o_custkey as epoch, o_orderkey as order_id, case when f.qty is not null then 'partially_filled' when o_orderstatus = 'O' then 'working' else 'cancelled' end as status, cast(coalesce(f.qty, 0) as bigint) as filled from orders left join filled f on l_orderkey = o_orderkey""",
    "reconciliation_epochs": """
        , marks as (select cast(user_id % 7 as varchar) as stream, seq as ordinal, seq // 40 as epoch, case when seq % 3 = 0 then 'finish' else 'begin' end as kind from ticks where k < 40),
        begun as (select *, last_value(case when kind = 'begin' then epoch end ignore nulls) over (partition by stream order by ordinal rows between unbounded preceding and current row) as open_epoch from marks),
        ends as (select stream, epoch, arg_max(kind, ordinal) as kind from begun where kind = 'begin' or epoch = open_epoch group by stream, epoch),
        latest as (select cast(user_id % 7 as varchar) as stream, k, arg_max(seq % 4 = 0, seq) as is_unknown from ticks where k >= 40 group by 1, 2), counts as (select stream, count(*) as n from latest where is_unknown group by stream)
        select e.stream, epoch, case kind when 'finish' then 'ready' else 'reconciling' end as state, coalesce(n, 0) as unknown, kind = 'finish' and coalesce(n, 0) = 0 as ready from ends e left join counts c on e.stream = c.stream""",
}
