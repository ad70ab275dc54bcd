"""A venue's account epoch: its responses, read by the column order that its own configuration gives.

One row holds one epoch (the responses to one refresh); its arrays are as long
as the account's open positions, orders and executions.  Everything is decided
inside the row, so decoding shuffles nothing; steps are written between.  An epoch is taken whole or not at
all: ``rejected`` names the first thing wrong with it, and its arrays are null
then.  Rows of instruments that are not bound are left out.

epochs: epoch_id, account_id, started_ns, received_ns; config, instruments,
account_state, positions, orders, order_history, executions (JSON); details and
quotes (array<struct<id bigint, payload string>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.scalars import decimal_precision, micros, nanos
from quayside.sources.shared import written

#: Tables of an epoch, the layout that orders their columns, and the columns they need.
TABLES = {
    "positions": ("positionsConfig", "positions", ("id", "tradableInstrumentId", "side", "qty", "avgPrice", "unrealizedPl", "openDate")),
    "orders": ("ordersConfig", "orders", ("id", "tradableInstrumentId", "side", "type", "status", "qty", "filledQty", "avgPrice", "createdDate", "isOpen")),
    "order_history": ("ordersHistoryConfig", "ordersHistory", ("id", "tradableInstrumentId", "side", "type", "status", "qty", "filledQty", "avgPrice", "createdDate", "isOpen")),
    "executions": ("filledOrdersConfig", "executions", ("id", "tradableInstrumentId", "orderId", "positionId", "side", "qty", "price", "createdDate")),
}
ACCOUNT = ("balance", "projectedBalance", "availableFunds", "todayNet", "todayFees", "openNetPnL")
#: Text columns; all others are numbers.
WORDS = ("side", "type", "status", "isOpen")
INSTRUMENTS = "s string, d struct<instruments:array<struct<tradableInstrumentId:string,name:string,routes:array<struct<id:string,type:string>>>>>"


def _names(layout: str) -> Column:
    table = F.from_json("config", f"s string, d struct<{layout}:struct<columns:array<struct<id:string>>>>")
    return F.transform(table["d"][layout]["columns"], lambda c: c["id"])


def _sound_layout(names: Column, needed: tuple[str, ...]) -> Column:
    wanted = F.array(*map(F.lit, needed))
    return F.coalesce((F.size(F.array_except(wanted, names)) == 0) & (F.size(F.array_distinct(names)) == F.size(names)), F.lit(False))


def _cell(row: Column, names: Column, name: str) -> Column:
    text = F.get(row, F.nullif(F.array_position(names, F.lit(name)), F.lit(0)).cast("int") - 1)
    return text if name in WORDS else text.try_cast("double") if name in ("qty", "filledQty", "avgPrice", "price", "unrealizedPl", *ACCOUNT) else text.try_cast("long")


def _first(payload: Column, keys: tuple[str, ...], kind: str) -> Column:
    return F.coalesce(*[F.get_json_object(payload, f"$.d.{k}").try_cast(kind) for k in keys])


def _find(rows: Column, ok) -> Column:
    return F.get(F.filter(rows, ok), F.lit(0))


def side(word: Column) -> Column:
    return F.when(F.lower(word) == "buy", "buy").when(F.lower(word) == "sell", "sell").otherwise("unknown")


def tick_size(payload: Column, mid: Column) -> Column:
    """A number for all prices, or that of the highest tier that begins at or below ``mid``; a tier without a start begins nowhere."""
    direct = F.coalesce(F.get_json_object(payload, "$.d.priceIncrement").try_cast("double"), F.get_json_object(payload, "$.d.tickSize").try_cast("double"))
    tiers = F.from_json(F.get_json_object(payload, "$.d.tickSize"), "array<struct<leftRangeLimit:string,tickSize:string>>")
    lower = lambda t: F.coalesce(t["leftRangeLimit"].try_cast("double"), F.lit(float("-inf")))
    fits = F.filter(tiers, lambda t: (t["tickSize"].try_cast("double") > 0) & (lower(t) <= mid))
    tier = F.array_max(F.transform(fits, lambda t: F.struct(lower(t).alias("lower"), t["tickSize"].try_cast("double").alias("tick"))))["tick"]
    found = F.coalesce(direct, tier)
    return F.when(found > 0, found)


def _contract(bound: Column, details: Column, quotes: Column) -> Column:
    def one(b: Column) -> Column:
        payload = _find(details, lambda d: d["id"] == b["id"])["payload"]
        quote = _find(quotes, lambda q: q["inst"] == b["inst"])
        tick = tick_size(payload, quote["mid"] / b["scale"])
        route = lambda kind: _find(b["routes"], lambda r: r["type"] == kind)["id"].try_cast("int")
        return F.struct(
            b["inst"].alias("inst"), b["symbol"].alias("symbol"), b["id"].alias("venue_instrument"), route("INFO").alias("info_route"), route("TRADE").alias("trade_route"),
            _first(payload, ("tradeSessionId", "sessionId"), "int").alias("session"),
            micros(_first(payload, ("minLot", "minQty", "minQuantity", "lotSize"), "double")).alias("minimum"),
            micros(_first(payload, ("qtyStep", "quantityStep", "lotStep"), "double")).alias("step"),
            nanos(tick).alias("tick_nanos"),
            F.coalesce(_first(payload, ("pricePrecision", "precision"), "int"), decimal_precision(tick)).alias("precision"),
            F.coalesce(_first(payload, ("tradable", "isTradingAllowed", "sessionOpen"), "boolean"), F.get_json_object(payload, "$.d.symbolStatus") == "FULLY_OPEN", F.lit(False)).alias("session_open"),
        )

    return F.transform(bound, one)


def _row_reader(name: str, needed: tuple[str, ...], names: Column, bound: Column):
    """A positional row of a table to a struct of its columns and its instrument."""
    labels = [c for c in needed if c != "tradableInstrumentId"] + ["positionId"] * (name in ("orders", "order_history"))

    def read(r: Column) -> Column:
        inst = _find(bound, lambda b: b["id"] == _cell(r, names, "tradableInstrumentId"))["inst"]
        return F.struct(*[_cell(r, names, c).alias(c) for c in labels], inst.alias("inst"))

    return read


def _no_nulls(rows: Column, fields: tuple[str, ...]) -> Column:
    def full(r: Column) -> Column:
        out = F.lit(True)
        for f in fields:
            out = out & r[f].isNotNull()
        return out

    return F.coalesce(F.forall(rows, full), F.lit(False))


def decode(epochs: DataFrame, bindings: dict[str, tuple[int, int]]) -> DataFrame:
    """epoch_id, account_id, as_of_ns, rejected, account, contracts, quotes, positions, orders, order_history, executions.

    bindings: the venue's symbol to our instrument and its price scale.
    """
    known = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(i).cast("long").alias("inst"), F.lit(k).cast("long").alias("scale")) for s, (i, k) in bindings.items()])
    listed = F.from_json("instruments", INSTRUMENTS)["d"]["instruments"]

    def bind(r: Column) -> Column:
        b = _find(known, lambda k: k["symbol"] == r["name"])
        return F.struct(r["tradableInstrumentId"].try_cast("long").alias("id"), b["inst"].alias("inst"), b["symbol"].alias("symbol"), b["scale"].alias("scale"), r["routes"].alias("routes"))

    out = epochs.withColumn("__bound", F.filter(F.transform(listed, bind), lambda b: b["inst"].isNotNull() & b["id"].isNotNull()))
    bound = F.col("__bound")
    for name, (layout, key, _) in TABLES.items():
        table = F.from_json(name, f"s string, d struct<{key}:array<array<string>>>")
        out = out.withColumn(f"__names_{name}", _names(layout)).withColumn(f"__table_{name}", F.when(F.coalesce(table["s"], F.lit("ok")) == "ok", table["d"][key]))
    out = out.withColumn("__names", _names("accountDetailsConfig"))
    out = out.withColumn("__values", F.from_json("account_state", "s string, d struct<accountDetailsData:array<string>>")["d"]["accountDetailsData"])
    # Written step by step: one plan of all steps repeats the parsing in every expression that reads it.
    own = [c for c in out.columns if c.startswith("__")]
    out = written(out.select("epoch_id", "account_id", "started_ns", "received_ns", "details", "quotes", *own), "venue-parsed")

    def quote(q: Column) -> Column:
        b = _find(bound, lambda x: x["id"] == q["id"])
        price = lambda k: F.round(F.get_json_object(q["payload"], f"$.d.{k}").try_cast("double") * b["scale"]).try_cast("long")
        return F.struct(b["inst"].alias("inst"), price("bp").alias("bid"), price("ap").alias("ask"), F.call_function("div", price("bp") + price("ap"), F.lit(2)).alias("mid"))

    out = out.withColumn("__quotes", F.transform("quotes", quote))
    out = written(out.drop("quotes"), "venue-quoted")
    out = out.withColumn("__contracts", F.array_sort(_contract(bound, F.col("details"), F.col("__quotes"))))
    for name, (_, _, needed) in TABLES.items():
        read = _row_reader(name, needed, F.col(f"__names_{name}"), bound)
        out = out.withColumn(f"__rows_{name}", F.filter(F.transform(f"__table_{name}", read), lambda r: r["inst"].isNotNull()))
    names, values = F.col("__names"), F.col("__values")
    account = F.struct(*[micros(_cell(values, names, c)).alias(c) for c in ACCOUNT])
    there = {f"__there_{name}": F.col(f"__table_{name}").isNotNull() for name in TABLES}
    out = out.withColumn("__account", account).withColumns(there).withColumn("__n_details", F.size("details"))
    out = written(out.drop("details", "__values", *[f"__table_{name}" for name in TABLES]), "venue-rows")

    n = len(bindings)
    distinct = lambda c, f: F.size(F.array_distinct(F.transform(c, lambda x: x[f])))
    checks = [
        ("times", (F.col("started_ns") > 0) & (F.col("received_ns") >= F.col("started_ns"))),
        ("instruments", (F.size(bound) == n) & (distinct(bound, "inst") == n)),
        ("quotes", (F.size("__quotes") == n) & (distinct("__quotes", "inst") == n) & F.forall("__quotes", lambda q: q["inst"].isNotNull() & (q["bid"] <= q["ask"]))),
        ("contracts", (F.col("__n_details") == n) & _no_nulls(F.col("__contracts"), ("info_route", "trade_route", "session", "minimum", "step", "tick_nanos", "precision"))),
        ("account", _sound_layout(names, ACCOUNT) & F.forall(F.array(*[F.col(f"__account.{c}") for c in ACCOUNT]), lambda v: v.isNotNull())),
    ]
    for name, (_, _, needed) in TABLES.items():
        whole = F.col(f"__there_{name}") & _sound_layout(F.col(f"__names_{name}"), needed)
        checks.append((name, whole & _no_nulls(F.col(f"__rows_{name}"), tuple(c for c in needed if c != "tradableInstrumentId"))))
    rejected = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for what, ok in checks])
    out = out.withColumn("rejected", rejected)
    taken = lambda c: F.when(F.col("rejected").isNull(), c)
    arrays = [taken(F.array_sort(F.col(f"__rows_{name}"))).alias(name) for name in TABLES]
    return out.select("epoch_id", "account_id", F.col("received_ns").alias("as_of_ns"), "rejected", taken(F.col("__account")).alias("account"), taken(F.col("__contracts")).alias("contracts"), taken(F.col("__quotes")).alias("quotes"), *arrays)


def unknown_objects(decoded: DataFrame, known: DataFrame, table: str) -> DataFrame:
    """(epoch_id, id) of open orders or positions that ``known`` (account_id, id) lacks."""
    seen = decoded.select("epoch_id", "account_id", F.explode(F.transform(table, lambda r: r["id"])).alias("id"))
    return seen.join(known, ["account_id", "id"], "left_anti").select("epoch_id", "id")
