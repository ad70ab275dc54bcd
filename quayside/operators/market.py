"""The market desk: what a batch of events changes, which bars are valid, and series of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.sequences import with_lead_in

KINDS = ("index", "quote", "bar")
M4 = 4


def health(events: DataFrame) -> DataFrame:
    """One row: the desk's ten counters.

    events: batch, sequence, kind (null: not readable), known (the instrument is
    on the desk), in_session, minutes (of an external bar).
    """
    minutes = F.col("minutes").isin(4, 20, 120, 240)
    wanted = F.col("kind").isin(*KINDS) & F.col("known")
    odd_bar = wanted & (F.col("kind") == "bar") & ~F.coalesce(minutes, F.lit(False))
    count = lambda c: F.count(F.when(c, F.lit(1)))
    return events.agg(
        F.count_distinct("batch").alias("batches"),
        F.count(F.lit(1)).alias("events_seen"),
        count(wanted & (F.col("kind") == "index")).alias("reference_values"),
        count(wanted & (F.col("kind") == "quote")).alias("venue_quotes"),
        count(wanted & (F.col("kind") == "bar") & ~odd_bar).alias("external_bars"),
        count(F.col("kind").isNotNull() & ~F.col("kind").isin(*KINDS)).alias("ignored_events"),
        count(F.col("kind").isin(*KINDS) & ~F.col("known")).alias("unknown_instruments"),
        count(F.col("kind").isNull() | odd_bar).alias("invalid_events"),
        count(wanted & (F.col("kind") == "index") & ~F.col("in_session")).alias("bar_rejections"),
        F.max("sequence").alias("last_sequence"),
    )


def reference_values(events: DataFrame) -> DataFrame:
    """(inst, value, ts_ns, sequence) of each instrument after its events in order of sequence.

    events: inst, sequence, kind (index, bar), ts_ns, value.  An index value
    always replaces what is there; a bar only a value that is not newer than it.
    """
    point = F.struct("sequence", "ts_ns", "value")
    last = events.where(F.col("kind") == "index").groupBy("inst").agg(F.max(point).alias("p"))
    bars = events.where(F.col("kind") == "bar").join(last, "inst", "left")
    later = bars.where(F.col("p").isNull() | ((F.col("sequence") > F.col("p.sequence")) & (F.col("ts_ns") >= F.col("p.ts_ns"))))
    newest = later.groupBy("inst").agg(F.max(F.struct("ts_ns", "sequence", "value")).alias("b"))
    out = last.join(newest, "inst", "full")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"p.{c}")).alias(c)
    return out.select("inst", pick("value"), pick("ts_ns"), pick("sequence"))


def series_revisions(upserts: DataFrame, values: list[str]) -> DataFrame:
    """(inst, minutes, bars, revision): how often each series changed; a bar that comes again unchanged is no change.

    upserts: inst, minutes, open_ns, version and the bar's ``values``.
    """
    key = Window.partitionBy("inst", "minutes", "open_ns").orderBy("version")
    row = F.struct(*values)
    changed = upserts.withColumn("__changed", ~F.coalesce(F.lag(row).over(key) == row, F.lit(False)))
    return changed.groupBy("inst", "minutes").agg(F.count_distinct("open_ns").alias("bars"), F.count(F.when(F.col("__changed"), 1)).alias("revision"))


def bar_problem(instrument: Column, derivation: int) -> Column:
    """The first rule a bar breaks on its way into the structure of ``instrument``: inst, minutes, derivation, revision, first_seq, last_seq, open_ns, close_ns, o, h, l, c."""
    outside = lambda c: ~F.col(c).between(F.col("l"), F.col("h"))
    rules = [
        (F.col("inst") != instrument, "instrument"),
        (F.col("minutes") != M4, "timeframe"),
        (F.col("derivation") != derivation, "derivation"),
        (F.col("revision") > 0, "revised"),
        ((F.coalesce("first_seq", F.lit(0)) == 0) | (F.col("last_seq") < F.col("first_seq")), "not committed"),
        ((F.col("open_ns") >= F.col("close_ns")) | (F.col("l") > F.col("h")) | outside("o") | outside("c"), "geometry"),
    ]
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for broken, name in rules])


def true_ranges(bars: DataFrame) -> DataFrame:
    """``bars`` (inst, s_open, open_ns, h, l, c) with tr: the range, widened to the close before; windows run session by session."""
    rows = with_lead_in(bars, on=["inst"], cell="s_open", order="open_ns", n=1)
    pc = F.lag("c").over(Window.partitionBy("inst", "s_open").orderBy("open_ns"))
    h, low = F.col("h"), F.col("l")
    return rows.withColumn("tr", F.greatest(h - low, F.abs(h - F.coalesce(pc, h)), F.abs(low - F.coalesce(pc, low)))).where(~F.col("lead_in")).drop("lead_in")


def rolling(bars: DataFrame, length: int, /, **values: Column) -> DataFrame:
    """``bars`` (inst, s_open, open_ns) with aggregates over each bar and the length - 1 before it, across sessions; windows run session by session."""
    rows = with_lead_in(bars, on=["inst"], cell="s_open", order="open_ns", n=length - 1)
    w = Window.partitionBy("inst", "s_open").orderBy("open_ns").rowsBetween(1 - length, Window.currentRow)
    return rows.withColumns({name: value.over(w) for name, value in values.items()}).where(~F.col("lead_in")).drop("lead_in")


def gaps(bars: DataFrame) -> DataFrame:
    """``bars`` (inst, s_open, s_close, open_ns, close_ns) with gapped: 1 from the first missing bar of the instrument on."""
    from quayside.operators.sequences import running_max

    rows = with_lead_in(bars, on=["inst"], cell="s_open", order="open_ns", n=1)
    w = Window.partitionBy("inst", "s_open").orderBy("open_ns")
    # The lead-in stands in this session's cell, but keeps the session it belongs to in p_open.
    rows = rows.withColumn("pclose", F.lag("close_ns").over(w)).withColumn("p_end", F.lag("s_close").over(w)).withColumn("p_lead", F.lag("lead_in").over(w)).where(~F.col("lead_in"))
    first = F.col("pclose").isNull()
    other = F.col("p_lead")
    gap = F.when(first, F.col("open_ns") != F.col("s_open")).when(~other, F.col("open_ns") > F.col("pclose")).otherwise((F.col("pclose") < F.col("p_end")) | (F.col("open_ns") > F.col("s_open")))
    flagged = rows.withColumn("gap", gap.cast("long")).drop("lead_in", "pclose", "p_end", "p_lead")
    seen = running_max(flagged, on=["inst"], cell="s_open", order=["open_ns"], value=F.col("gap"), into="__before")
    return seen.withColumn("gapped", F.greatest("gap", F.coalesce("__before", F.lit(0)))).drop("gap", "__before")
