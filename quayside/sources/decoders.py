"""Provider payloads (one JSON document a row) to typed observations.

Each decoder takes (receipt_id, payload) and returns one row per observation:
receipt_id, series, period_start (date), value (double) and what the provider
adds.  Schemas are explicit.  A document is judged inside its own row and fails
closed: one value, date or identity that is not as agreed, or a period that
comes twice, and it gives no rows at all, nor does a payload that does not parse
(``undecoded`` lists such receipts).  What the provider marks as missing is left
out and is no fault.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import scalars
from quayside.sources.documents import _observed, _spread_out

LABOUR = "Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string,footnotes:array<struct<code:string>>>>>>>"
RATES = "units string, output_type int, observations array<struct<date:string,value:string>>"
ACCOUNTS = "BEAAPI struct<Results:struct<Data:array<struct<TableName:string,LineNumber:string,TimePeriod:string,CL_UNIT:string,DataValue:string>>>>"
STAT_CUBE = "version string, class string, id array<string>, size array<int>, dimension struct<time:struct<category:struct<index:map<string,int>>>>, value map<string,double>, status map<string,string>"
PARALLEL = "STATUS int, NEXTPOSITION string, RESULTSET array<struct<SERIES_CODE:string,VALUES:struct<SURVEY_DATES:array<bigint>,VALUES:array<double>>>>"
AGGREGATES = "ticker string, resultsCount bigint, results array<struct<o:double,h:double,l:double,c:double,t:bigint>>"


def _parsed(receipts: DataFrame, schema: str) -> DataFrame:
    return receipts.select("receipt_id", F.from_json("payload", schema).alias("p"))


def _first_of_month(year: Column, month: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("01")), "yyyy-MM-dd")


def _point(start: Column, value: Column, **more: Column) -> Column:
    return F.struct(start.alias("period_start"), value.alias("value"), *[c.alias(n) for n, c in more.items()])


def _truly(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def labour_series(receipts: DataFrame) -> DataFrame:
    """The one series of a receipt: months M01 to M12 (M13, the year, is skipped), ``-`` is missing, footnote P means provisional."""
    rows = _parsed(receipts, LABOUR).withColumn("series", F.col("p.Results.series"))
    data = F.filter(F.get(F.col("series"), F.lit(0))["data"], lambda d: _truly(d["value"] != "-") & ~_truly(d["period"] == "M13"))

    def read(d: Column) -> Column:
        month = F.regexp_extract(d["period"], r"^M(0[1-9]|1[0-2])$", 1)
        return _point(_first_of_month(d["year"], F.nullif(month, F.lit(""))), d["value"].try_cast("double"), provisional=_truly(F.exists(d["footnotes"], lambda f: f["code"] == "P")))

    names = rows.select("receipt_id", F.get("series", F.lit(0))["seriesID"].alias("series"))
    out = _spread_out(rows, F.transform(data, read), (F.size("series") == 1) & F.get("series", F.lit(0))["seriesID"].isNotNull(), _observed, lambda r: r["period_start"])
    return out.join(names, "receipt_id").select("receipt_id", "series", "period_start", "value", "provisional")


def daily_rates(receipts: DataFrame, series: str) -> DataFrame:
    """Daily observations in levels (``lin``, output type 1); ``.`` is missing."""
    rows = _parsed(receipts, RATES)
    held = F.filter("p.observations", lambda o: ~_truly(o["value"] == "."))
    points = F.transform(held, lambda o: _point(F.try_to_date(o["date"], "yyyy-MM-dd"), o["value"].try_cast("double")))
    sound = _truly((F.col("p.units") == "lin") & (F.col("p.output_type") == 1))
    return _spread_out(rows, points, sound, _observed, lambda r: r["period_start"]).select("receipt_id", F.lit(series).alias("series"), "period_start", "value")


def national_accounts(receipts: DataFrame, table: str, line: str, unit: str | None = None) -> DataFrame:
    """One line of one table in one unit; quarters ``2024Q1`` and months ``2024M01``, thousands separators dropped."""
    rows = _parsed(receipts, ACCOUNTS)
    mine = F.filter("p.BEAAPI.Results.Data", lambda d: _truly((d["TableName"] == table) & (d["LineNumber"] == line)))
    points = F.transform(mine, lambda d: _point(period_start(d["TimePeriod"]), F.regexp_replace(d["DataValue"], ",", "").try_cast("double"), unit=d["CL_UNIT"]))
    ok = lambda r: _observed(r) & (F.lit(True) if unit is None else _truly(r["unit"] == unit))
    return _spread_out(rows, points, F.lit(True), ok, lambda r: r["period_start"]).select("receipt_id", F.lit(f"{table}:{line}").alias("series"), "period_start", "value")


def period_start(label: Column) -> Column:
    """First day of ``2024Q1``, ``2024-Q1``, ``2024M01``, ``2024-01``, ``202401``, ``2024 Q1``, ``2024 JAN``, ``05 Jan 2024`` (that day) and ``2024-01-05`` (that day); null for anything else."""
    year = F.substring(label, 1, 4)
    quarter = F.nullif(F.regexp_extract(label, r"^\d{4}[- ]?Q([1-4])$", 1), F.lit(""))
    month = F.nullif(F.regexp_extract(label, r"^\d{4}[-M]?(0[1-9]|1[0-2])$", 1), F.lit(""))
    named = F.when(label.rlike(r"^\d{4} [A-Za-z]{3}$"), F.try_to_date(F.initcap(label), "yyyy MMM"))
    day = F.when(label.rlike(r"^\d{2} [A-Za-z]{3} \d{4}$"), F.try_to_date(F.initcap(label), "dd MMM yyyy"))
    iso = F.when(label.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(label, "yyyy-MM-dd"))
    return F.coalesce(_first_of_month(year, (quarter.try_cast("int") * 3 - 2).cast("string")), _first_of_month(year, month), named, day, iso)


def stat_cube(receipts: DataFrame, series: str) -> DataFrame:
    """A sparse cube whose dimensions but time have one member each: values by ordinal; status e or p means provisional."""
    rows = _parsed(receipts, STAT_CUBE)
    size = lambda i: F.get(F.col("p.size"), i)
    at_time = F.array_position("p.id", F.lit("time"))
    frozen = F.forall(F.sequence(F.lit(1), F.size("p.id")), lambda i: F.when(i == at_time, size(i - 1) == F.size(F.map_keys("p.dimension.time.category.index"))).otherwise(size(i - 1) == 1))
    sound = _truly((F.col("p.version") == "2.0") & (F.col("p.class") == "dataset") & (at_time > 0) & (F.size("p.id") == F.size("p.size")) & frozen)
    member = lambda name, t: F.try_element_at(F.col(f"p.{name}"), t["value"].cast("string"))
    held = F.filter(F.map_entries("p.dimension.time.category.index"), lambda t: member("value", t).isNotNull())
    status = lambda t: F.when(F.col("p.status").isNotNull(), member("status", t))
    points = F.transform(held, lambda t: _point(period_start(t["key"]), member("value", t), provisional=_truly(status(t).isin("e", "p")), ordinal=t["value"]))
    out = _spread_out(rows, points, sound, _observed, lambda r: r["ordinal"])
    return out.select("receipt_id", F.lit(series).alias("series"), "period_start", "value", "provisional")


def parallel_arrays(receipts: DataFrame) -> DataFrame:
    """Dates and values as parallel arrays of one length, whole in one page; null values are skipped; yyyymmdd days, yyyyqq quarters."""
    rows = _parsed(receipts, PARALLEL)
    sets = F.col("p.RESULTSET")
    one_length = F.forall(sets, lambda r: _truly(r["SERIES_CODE"].isNotNull() & (F.size(r["VALUES"]["SURVEY_DATES"]) == F.size(r["VALUES"]["VALUES"]))))
    sound = _truly((F.col("p.STATUS") == 200) & F.col("p.NEXTPOSITION").isNull() & one_length)

    def read(r: Column) -> Column:
        pairs = F.filter(F.arrays_zip(r["VALUES"]["SURVEY_DATES"].alias("d"), r["VALUES"]["VALUES"].alias("v")), lambda x: x["v"].isNotNull())
        return F.transform(pairs, lambda x: _point(_numbered_day(x["d"]), x["v"], series=r["SERIES_CODE"]))

    out = _spread_out(rows, F.flatten(F.transform(sets, read)), sound, _observed, lambda r: F.struct(r["series"], r["period_start"]))
    return out.select("receipt_id", "series", "period_start", "value")


def _numbered_day(d: Column) -> Column:
    """The day ``yyyymmdd``, or the first one of the quarter ``yyyyqq``."""
    text = d.cast("string")
    return F.when(d > 9_999_999, F.try_to_date(text, "yyyyMMdd")).when((d % 100).between(1, 4), _first_of_month(F.substring(text, 1, 4), d % 100 * 3 - 2))


def aggregate_bars(receipts: DataFrame, scale: int) -> DataFrame:
    """(receipt_id, ticker, open_ns, o, h, l, c) as scaled integers; the count must be that of the rows, and no time comes twice."""
    rows = _parsed(receipts, AGGREGATES)

    def read(b: Column) -> Column:
        return F.struct(F.try_multiply(b["t"], F.lit(1_000_000)).alias("open_ns"), *[scalars.scale_exact(b[c], scale).alias(c) for c in "ohlc"])

    def ok(b: Column) -> Column:
        shape = (b["l"] <= F.least(b["o"], b["c"])) & (b["h"] >= F.greatest(b["o"], b["c"]))
        return b["open_ns"].isNotNull() & F.coalesce(shape, F.lit(False))

    sound = _truly((F.col("p.resultsCount") == F.size("p.results")) & F.col("p.ticker").isNotNull())
    tickers = rows.select("receipt_id", F.col("p.ticker").alias("ticker"))
    points = F.array_sort(F.transform("p.results", read))
    return _spread_out(rows, points, sound, ok, lambda b: b["open_ns"]).join(tickers, "receipt_id").select("receipt_id", "ticker", "open_ns", *"ohlc")


def undecoded(receipts: DataFrame, decoded: DataFrame) -> DataFrame:
    return receipts.join(decoded.select("receipt_id").distinct(), "receipt_id", "left_anti")


@dataclass(frozen=True)
class Decoder:
    """How the payloads of one stream are read: a function of (receipt_id, payload), and how many provider records a payload has."""

    stream: str
    read: Callable[[DataFrame], DataFrame]
    records: Callable[[Column], Column]


#: Streams and their decoders; a caller adds its own as ``DECODERS | {...}``.
DECODERS = {
    "labour": Decoder("labour", labour_series, lambda p: F.size(F.get(F.from_json(p, LABOUR)["Results"]["series"], F.lit(0))["data"])),
    "rates": Decoder("rates", lambda r: daily_rates(r, "rate"), lambda p: F.size(F.from_json(p, RATES)["observations"])),
    "accounts": Decoder("accounts", lambda r: national_accounts(r, "T10101", "1"), lambda p: F.size(F.from_json(p, ACCOUNTS)["BEAAPI"]["Results"]["Data"])),
    "cube": Decoder("cube", lambda r: stat_cube(r, "cube"), lambda p: F.size(F.map_keys(F.from_json(p, STAT_CUBE)["value"]))),
    "arrays": Decoder("arrays", parallel_arrays, lambda p: F.size(F.flatten(F.transform(F.from_json(p, PARALLEL)["RESULTSET"], lambda r: r["VALUES"]["VALUES"])))),
}


def decode(receipts: DataFrame, decoders: dict[str, Decoder] = DECODERS) -> DataFrame:
    """(stream, receipt_id, series, period_start, value) of receipts (stream, receipt_id, payload); a stream without a decoder gives nothing."""
    parts = [d.read(receipts.where(F.col("stream") == s)).select(F.lit(s).alias("stream"), "receipt_id", "series", "period_start", "value") for s, d in decoders.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def statistics(receipts: DataFrame, decoded: DataFrame, decoders: dict[str, Decoder] = DECODERS) -> DataFrame:
    """(stream, receipts, refused, records, events): what each stream brought and what was made of it."""
    size = F.lit(None).cast("int")
    for s, d in decoders.items():
        size = F.when(F.col("stream") == s, d.records(F.col("payload"))).otherwise(size)
    made = decoded.groupBy("stream", "receipt_id").agg(F.count(F.lit(1)).alias("events"))
    each = receipts.select("stream", "receipt_id", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).alias("records")).join(made, ["stream", "receipt_id"], "left")
    return each.groupBy("stream").agg(F.count(F.lit(1)).alias("receipts"), F.count(F.when(F.col("events").isNull(), 1)).alias("refused"), F.sum("records").cast("long").alias("records"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))
