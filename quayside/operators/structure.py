"""Price levels that bars give rise to, as mutations of the level book.

Three producers read the bars of an instrument: the session's extremes with
their bands and those of the session before, the opening range, and projections
of the rolling range.  What each does at a bar depends on running extremes and
on which bar is the first of its session, so all are window expressions over
bars; no state is carried by hand.  A bar at which any level changes makes one
generation.

bars: inst, s_open, s_close, open_ns, close_ns, o, h, l, c; one row a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scalars import midpoint, rotated, whole_quotient
from quayside.operators import levels as book
from quayside.operators import market, nodes
from quayside.operators.nodes import CENTER, LOWER, NEUTRAL, UPPER
from quayside.operators.sequences import running_rank, with_lead_in
from quayside.sources.shared import written

SESSION, OPENING, PROJECTION = 1, 2, 3
#: Sessions whose extreme bands stay after their end.
RETAINED = 5
OPENING_NS = 1_200_000_000_000
LOOKBACK = 20
#: Fractions of the rolling range, in parts per million.
FRACTIONS = (0, 213_000, 333_000, 500_000, 666_000, 750_000, 900_000, 1_000_000)
ATR_BARS = 14


def _session(last: int):
    """The bars of the session up to this one (0) or the one before (-1)."""
    return Window.partitionBy("inst", "s_open").orderBy("open_ns").rowsBetween(Window.unboundedPreceding, last)


def level_id(producer: int, inst: Column, number: Column) -> Column:
    return F.lit(producer << 48) + inst * (1 << 32) + number


def _mutation(producer: int, rank: int, kind: str, number: Column, side: int, *, at: Column | None = None, lower: Column | None = None, upper: Column | None = None, price: Column | None = None, group: Column | None = None) -> Column:
    none = F.lit(None).cast("long")
    price = none if price is None else price
    return F.struct(
        (F.col("open_ns") if at is None else at).alias("bar_ns"),
        F.lit(100 * producer + rank).alias("ordinal"),
        F.lit(kind).alias("kind"),
        level_id(producer, F.col("inst"), number).alias("level_id"),
        (price if lower is None else lower).alias("lower"),
        (price if upper is None else upper).alias("upper"),
        price.alias("price"),
        (F.lit(0).cast("long") if group is None else group).alias("group_id"),
        F.lit(side).alias("side"),
        F.lit(producer).alias("family"),
    )


def _listed(rows: DataFrame, when_: list[tuple[Column, Column]]) -> DataFrame:
    """The mutations whose condition holds and that some bar triggers."""
    every = F.array_compact(F.array(*[F.when(c, m) for c, m in when_]))
    return rows.select("inst", F.inline(every)).where(F.col("bar_ns").isNotNull())


def session_mutations(bars: DataFrame) -> DataFrame:
    sessions = bars.groupBy("inst", "s_open").agg(F.min("open_ns").alias("first_ns"), F.max("h").alias("hi"), F.min("l").alias("lo"))
    w = Window.partitionBy("inst").orderBy("s_open")
    sessions = sessions.select(
        "inst", "s_open", "first_ns", F.row_number().over(w).cast("long").alias("k"), F.lead("first_ns", 1).over(w).alias("next_ns"), F.lead("first_ns", RETAINED + 1).over(w).alias("band_end_ns"),
        F.lag("hi").over(w).alias("prev_hi"), F.lag("lo").over(w).alias("prev_lo"), F.lag("s_open").over(w).alias("prev_open"),
    )
    base = F.when(F.col("k") == 1, F.lit(0)).otherwise(4 + 6 * (F.col("k") - 2) + 2)
    own, before = rotated(F.col("s_open"), 17).bitwiseXOR(F.lit(1).cast("long")), rotated(F.col("prev_open"), 17).bitwiseXOR(F.lit(2).cast("long"))
    old = F.col("k") > 1
    ends, always = [], F.lit(True)
    for i, side in ((1, UPPER), (2, LOWER)):
        ends += [(always, _mutation(SESSION, i, "frozen", base + i, side, at=F.col("next_ns"))), (always, _mutation(SESSION, 2 + i, "expired", base + i, side, at=F.col("next_ns")))]
        ends += [(always, _mutation(SESSION, 4 + i, "frozen", base + 2 + i, side, at=F.col("next_ns"))), (always, _mutation(SESSION, 6 + i, "expired", base + 2 + i, side, at=F.col("band_end_ns")))]
        prior = F.col("prev_hi" if side == UPPER else "prev_lo")
        ends += [(old, _mutation(SESSION, 8 + i, "created", base - 2 + i, side, at=F.col("first_ns"), price=prior, group=before)), (old, _mutation(SESSION, 10 + i, "expired", base - 2 + i, side, at=F.col("next_ns")))]
    at_ends = _listed(sessions, ends)

    run = bars.withColumn("ph", F.max("h").over(_session(-1))).withColumn("pl", F.min("l").over(_session(-1))).join(sessions.select("inst", "s_open", "k"), ["inst", "s_open"])
    high, low = F.col("ph").isNull() | (F.col("h") > F.col("ph")), F.col("pl").isNull() | (F.col("l") < F.col("pl"))
    body_top, body_low = F.greatest("o", "c"), F.least("o", "c")
    moves = []
    for kind, first in (("created", F.col("ph").isNull()), ("updated", F.col("ph").isNotNull())):
        moves += [
            (high & first, _mutation(SESSION, 21, kind, base + 1, UPPER, price=F.col("h"), group=own)),
            (low & first, _mutation(SESSION, 22, kind, base + 2, LOWER, price=F.col("l"), group=own)),
            (high & first, _mutation(SESSION, 23, kind, base + 3, UPPER, lower=body_top, upper=F.col("h"), price=F.col("h"))),
            (low & first, _mutation(SESSION, 24, kind, base + 4, LOWER, lower=F.col("l"), upper=body_low, price=F.col("l"))),
        ]
    return at_ends.unionByName(_listed(run, moves))


def opening_mutations(bars: DataFrame, duration_ns: int = OPENING_NS) -> DataFrame:
    form_end = F.least(F.col("s_open") + duration_ns, F.col("s_close"))
    forming = bars.where(F.col("open_ns") < form_end)
    w = Window.partitionBy("inst").orderBy("s_open")
    starts = bars.groupBy("inst", "s_open").agg(F.min("open_ns").alias("first_ns"), F.min(F.when(F.col("open_ns") >= form_end, F.col("open_ns"))).alias("done_ns"), F.min("s_close").alias("s_close"))
    starts = starts.withColumn("next_ns", F.lead("first_ns").over(w)).where(F.col("first_ns") < F.col("s_open") + duration_ns)
    starts = starts.withColumn("number", 3 * (F.row_number().over(w) - 1)).withColumn("freeze_ns", F.coalesce("done_ns", "next_ns"))
    group = rotated(F.col("s_open"), 21).bitwiseXOR(F.lit(duration_ns))
    sides = ((1, UPPER), (2, LOWER), (3, CENTER))
    ends = _listed(starts, [(F.lit(True), _mutation(OPENING, r + i, kind, F.col("number") + i, side, at=F.col(at))) for i, side in sides for r, kind, at in ((0, "frozen", "freeze_ns"), (3, "expired", "next_ns"))])
    upto = _session(0)
    run = forming.select("*", F.max("h").over(upto).alias("hi"), F.min("l").over(upto).alias("lo"), F.max("h").over(_session(-1)).alias("ph"), F.min("l").over(_session(-1)).alias("pl"))
    run = run.join(starts.select("inst", "s_open", "number"), ["inst", "s_open"])
    prices = {1: F.col("hi"), 2: F.col("lo"), 3: midpoint(F.col("lo"), F.col("hi"))}
    changed = (F.col("hi") != F.col("ph")) | (F.col("lo") != F.col("pl"))
    moves = [(c, _mutation(OPENING, 10 + i, kind, F.col("number") + i, side, price=prices[i], group=group)) for i, side in sides for kind, c in (("created", F.col("ph").isNull()), ("updated", changed))]
    return ends.unionByName(_listed(run, moves))


def projection_mutations(bars: DataFrame, lookback: int = LOOKBACK, fractions: tuple[int, ...] = FRACTIONS) -> DataFrame:
    rows = with_lead_in(bars, on=["inst"], cell="s_open", order="open_ns", n=lookback)
    over = lambda first, last: Window.partitionBy("inst", "s_open").orderBy("open_ns").rowsBetween(first, last)
    now, before = over(1 - lookback, 0), over(-lookback, -1)
    run = rows.select("inst", "open_ns", "lead_in", F.max("h").over(now).alias("hi"), F.min("l").over(now).alias("lo"), F.count("h").over(now).alias("n"), F.max("h").over(before).alias("phi"), F.min("l").over(before).alias("plo"))
    epochs = bars.groupBy("inst").agg(F.min("open_ns").alias("epoch"))
    run = run.where(~F.col("lead_in")).join(epochs, "inst")
    price = lambda hi, lo, f: F.col(lo) + whole_quotient((F.col(hi) - F.col(lo)) * f, F.lit(1_000_000))
    group = rotated(F.col("epoch"), 29).bitwiseXOR(F.lit(lookback).cast("long"))
    moves = []
    for i, f in enumerate(fractions):
        side = LOWER if i == 0 else UPPER if i + 1 == len(fractions) else CENTER if 2 * i == len(fractions) - 1 else NEUTRAL
        now, before = price("hi", "lo", f), price("phi", "plo", f)
        for kind, c in (("created", F.col("n") == 2), ("updated", (F.col("n") > 2) & (now != before))):
            moves.append((c, _mutation(PROJECTION, i, kind, F.lit(i + 1), side, price=now, group=group)))
    return _listed(run, moves)


def mutations(bars: DataFrame) -> DataFrame:
    """All producers' mutations, numbered by generation: inst, generation, bar_ns, ordinal, kind, level_id, ..."""
    bars = written(bars, "structure-bars")
    every = session_mutations(bars).unionByName(opening_mutations(bars)).unionByName(projection_mutations(bars))
    moments = every.select("inst", "bar_ns", F.expr("bar_ns div 86400000000000").alias("day")).distinct()
    numbered = running_rank(written(moments, "structure-moments"), on=("inst",), cell="day", order=["bar_ns"], into="generation").select("inst", "bar_ns", F.col("generation").cast("long").alias("generation"))
    return every.join(numbered, ["inst", "bar_ns"])


def average_range(bars: DataFrame) -> DataFrame:
    """``bars`` with atr: the mean true range of the last bars, as many as there are, cut to an integer."""
    ranged = market.rolling(market.true_ranges(bars), ATR_BARS, total=F.sum("tr"), n=F.count("tr"))
    return ranged.withColumn("atr", whole_quotient(F.col("total"), F.col("n"))).drop("tr", "total", "n")


def structure(bars: DataFrame, *, noise: int = 1, tick: int = 1) -> DataFrame:
    """(inst, generation, bar_ns, at_ns, atr, nodes, events): the nodes after every bar that changed a level."""
    bars = written(bars, "structure-bars")
    log = written(mutations(bars), "structure-log")
    ranges = average_range(bars).select("inst", F.col("open_ns").alias("bar_ns"), F.col("close_ns").alias("at_ns"), "atr")
    generations = log.select("inst", "generation", "bar_ns").distinct().join(ranges, ["inst", "bar_ns"])
    one = lambda n: F.lit(n).cast("long")
    generations = written(generations.withColumn("threshold", nodes.merge_threshold(F.col("atr"), one(noise), one(tick))), "structure-generations")
    live = book.active(book.versions(log), generations.select("inst", "generation", "at_ns", "threshold"))
    chained = nodes.genealogy(nodes.clusters(live))
    return generations.select("inst", "generation", "bar_ns", "at_ns", "atr").join(chained, ["inst", "generation"])
