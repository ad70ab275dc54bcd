"""Control of live trading: gates, modes and routes, contract agreement, and what the desk's pages select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.sequences import running_last

#: The conditions of the live gate, and the reasons that block it, in order.
CONDITIONS = ("data_fresh", "engine_ready", "venue_ready", "contracts_agree", "clock_synchronized", "reconciled", "no_unknown_orders")
REASONS = ("data stale", "engine not ready", "venue not ready", "contract mismatch", "clock unsynchronized", "reconciliation incomplete", "unknown order outcome")
#: Availabilities with a value, and those of a broken input.
VALUED, BROKEN = ("ready", "live", "delayed", "stale", "replaying"), ("invalid", "disconnected")


def block_reasons() -> Column:
    """The reasons of the conditions that do not hold, or are not known, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(r)) for c, r in zip(CONDITIONS, REASONS, strict=True)]))


def gate(states: DataFrame) -> DataFrame:
    """``states`` (the seven conditions) with ``reasons`` and ``ready``."""
    return states.withColumn("reasons", block_reasons()).withColumn("ready", F.size("reasons") == 0)


def modes(commands: DataFrame, *, on: list[str], cell: str, order: str) -> DataFrame:
    """``commands`` with the mode after each, the reasons that block then, and the route of an intent that comes next.

    commands: command (health, agreement, mode, arm, halt), mode (of a mode
    command), and the seven conditions as they stand after it.  A mode command
    sets any mode but live; arming sets it where nothing blocks.  The first
    health report leads out of ``disconnected`` to ``read_only``; a health report
    with a blocked gate, or contracts that disagree, end live trading, for which
    it then has to be armed again.
    """
    blocked = F.size("reasons") > 0
    rows = commands.withColumn("reasons", block_reasons())
    sets = F.when((F.col("command") == "mode") & (F.col("mode") != "live"), F.col("mode")).when((F.col("command") == "arm") & ~blocked, F.lit("live")).when(F.col("command") == "halt", F.lit("halted"))
    rows = rows.withColumn("__set", sets)
    # What ends live trading, and what leads out of disconnection; each since the mode was set last.
    ends = ((F.col("command") == "health") & blocked) | ((F.col("command") == "agreement") & ~F.coalesce(F.col("contracts_agree"), F.lit(False)))
    at = F.col(order)
    for name, value in (("__mode", F.when(F.col("__set").isNotNull(), F.struct(at.alias("at"), F.col("__set").alias("mode")))), ("__ended", F.when(ends, at)), ("__health", F.when(F.col("command") == "health", at))):
        rows = running_last(rows.withColumn("__own", value), on=on, cell=cell, order=[order], value=F.col("__own"), into=name)
        rows = rows.withColumn(name, F.coalesce("__own", name)).drop("__own")
    base, since = F.coalesce("__mode.mode", F.lit("disconnected")), F.coalesce("__mode.at", F.lit(-1))
    after = F.when((base == "live") & (F.col("__ended") > since), "read_only").when((base == "disconnected") & (F.col("__health") > since), "read_only").otherwise(base)
    route = F.when(F.col("after") == "simulation", "simulate").when(F.col("after") == "shadow", "shadow only").when((F.col("after") == "live") & ~blocked, "transmit").when(F.col("after") == "halted", "refused: halted").otherwise("refused: not armed")
    return rows.withColumn("after", after).withColumn("route", route).drop("__set", "__mode", "__ended", "__health")


def contract_agreement(venue: DataFrame, cached: DataFrame, terms: list[str]) -> DataFrame:
    """(inst, agrees): all ``terms`` equal, nulls too, with route and session open; an instrument that is not cached does not agree."""
    ours = cached.select(F.col("inst").alias("__inst"), *[F.col(t).alias(f"__{t}") for t in terms])
    same = F.col("route_open") & F.col("session_open") & F.col("__inst").isNotNull()
    for t in terms:
        same = same & F.col(t).eqNullSafe(F.col(f"__{t}"))
    return venue.join(ours, F.col("inst") == F.col("__inst"), "left").select("inst", F.coalesce(same, F.lit(False)).alias("agrees"))


def combined(left: Column, right: Column) -> Column:
    """The availability of what needs both inputs."""
    broken = left.isin(*BROKEN) | right.isin(*BROKEN)
    return F.when(left.isin(*VALUED) & right.isin(*VALUED), "ready").when(broken, "invalid").otherwise("awaiting")


def desk_exposure(instruments: DataFrame, positions: DataFrame) -> DataFrame:
    """Each instrument of the desk with its net quantity and profit: positions: inst, side (buy, sell, unknown), qty, pnl."""
    signed = F.when(F.col("side") == "buy", F.col("qty")).when(F.col("side") == "sell", -F.col("qty")).otherwise(F.lit(0))
    held = positions.groupBy("inst").agg(F.sum(signed).alias("net"), F.sum("pnl").alias("pnl"))
    zero = F.lit(0).cast("long")
    out = instruments.join(held, "inst", "left")
    return out.select("inst", F.coalesce("net", zero).alias("net"), F.coalesce("pnl", zero).alias("pnl"), F.when(F.coalesce("net", zero) == 0, "flat").otherwise("open").alias("state"))


def repaired_selection(wanted: DataFrame, rows: DataFrame, *, on: str, item: str, order: str) -> DataFrame:
    """(on, item): what each view shows as selected: the wanted item if its rows still have it, else their first; null without rows.

    wanted: on, item; rows: on, item, order.
    """
    first = rows.groupBy(on).agg(F.min_by(item, order).alias("__first"))
    there = rows.select(F.col(on).alias("__on"), F.col(item).alias("__item")).distinct()
    found = wanted.join(there, (F.col(on) == F.col("__on")) & (F.col(item) == F.col("__item")), "left").join(first, on, "left")
    return found.select(on, F.coalesce("__item", "__first").alias(item))


def gates_passed(gates: DataFrame) -> DataFrame:
    """(strategy, passed, n): gates: strategy, gate, status."""
    return gates.groupBy("strategy").agg(F.count(F.when(F.col("status") == "pass", 1)).alias("passed"), F.count(F.lit(1)).alias("n"))


def selected_account(accounts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request, account, problem): the account whose id or number is asked for, if exactly one is.

    accounts: account, number; wanted: request, account, number (either may be null).
    """
    by = lambda account, number: F.inline(F.array(*[F.struct(F.lit(n).alias("by"), F.col(c).alias("value")) for n, c in (("account", account), ("number", number))]))
    # Whether a value has one account or several shows in the least and the largest: accounts of one number are not spread over all that ask for it.
    held = accounts.select("account", "number").withColumn("__account", F.col("account")).select("__account", by("account", "number")).where(F.col("value").isNotNull())
    held = held.groupBy("by", "value").agg(F.min("__account").alias("__least"), F.max("__account").alias("__most"))
    met = wanted.select("request", by("account", "number")).join(held, ["by", "value"]).groupBy("request").agg(F.min("__least").alias("__one"), F.max("__most").alias("__other"))
    out = wanted.select("request").join(met, "request", "left")
    one = F.col("__one") == F.col("__other")
    return out.select("request", F.when(one, F.col("__one")).alias("account"), F.when(F.col("__one").isNull(), "not found").when(~one, "ambiguous").alias("problem"))


#: Widths that a bar of the chart can have, and how far it scrolls past the last bar.
NARROWEST, WIDEST, PAST_END = 3.0, 24.0, 6.0


def zoomed(spacing: Column, scroll: Column, bars: Column, width: Column, factor: Column, anchor: Column) -> tuple[Column, Column]:
    """Bar width and scroll after a zoom that keeps the bar at ``anchor`` (0 to 1 of the width) in its place."""
    new = F.greatest(F.least(spacing * factor, F.lit(WIDEST)), F.lit(NARROWEST))
    x = F.greatest(F.least(anchor, F.lit(1.0)), F.lit(0.0)) * width
    at = bars - width / spacing + scroll + x / spacing
    moved = at - x / new - bars + width / new
    return new, F.when(new == spacing, scroll).otherwise(clamped_scroll(moved, bars))


def clamped_scroll(scroll: Column, bars: Column) -> Column:
    return F.greatest(F.least(scroll, F.lit(PAST_END)), -bars.cast("double"))


def visible_slots(spacing: Column, scroll: Column, bars: Column, width: Column) -> tuple[Column, Column]:
    """First slot that is seen, and the first behind the last one."""
    first = F.greatest(F.floor(bars - width / spacing + scroll), F.lit(0))
    last = F.least(F.greatest(F.ceil(bars + scroll), F.lit(0)), bars)
    return F.least(first, last).cast("long"), last.cast("long")
