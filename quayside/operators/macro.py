"""The macro office: what its events add up to, positioning, releases, feeds and refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.sequences import running_max

#: Kinds of events that the office takes, weeks of positioning and releases that it shows.
KINDS = ("observation", "positioning", "release", "document")
WEEKS, RELEASES = 104, 128


def project(events: DataFrame, *, on: list[str], cell: str, order: str) -> DataFrame:
    """One row a key: what the office holds after its events, taken in ``order`` up to the first whose sequence does not rise.

    events: kind, sequence, receipt, source, stream, received_ns.  Events of other
    kinds are passed over.  stopped_at: the first sequence that is not above all
    before it; null if all events were taken.
    """
    mine = events.where(F.col("kind").isin(*KINDS))
    seen = running_max(mine, on=on, cell=cell, order=[order], value=F.col("sequence"), into="before")
    wrong = (F.coalesce("sequence", F.lit(0)) <= 0) | (F.col("sequence") <= F.coalesce("before", F.lit(0)))
    stops = seen.where(wrong).groupBy(*on).agg(F.min(order).alias("stop"), F.min_by("sequence", order).alias("stopped_at"))
    taken = seen.join(stops, on, "left")
    fine = F.col("stop").isNull() | (F.col(order) < F.col("stop"))
    count = lambda c: F.count(F.when(fine & c, F.lit(1)))
    return taken.groupBy(*on).agg(
        count(F.lit(True)).alias("events"),
        count(F.col("kind").isin("observation", "positioning")).alias("data_events"),
        count(F.col("kind") == "document").alias("documents"),
        count(F.col("kind") == "release").alias("releases"),
        F.count_distinct(F.when(fine, F.col("receipt"))).alias("receipts"),
        F.count_distinct(F.when(fine, F.struct("source", "stream"))).alias("feeds"),
        F.coalesce(F.max(F.when(fine, F.col("sequence"))), F.lit(0)).alias("last_sequence"),
        F.coalesce(F.max(F.when(fine, F.col("received_ns"))), F.lit(0)).alias("as_of_ns"),
        F.first("stopped_at").alias("stopped_at"),
    )


def positioning(points: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """The latest vintage of each report of the last ``weeks``: market, participant, report_date, long_q, short_q, net, age, newest (market).

    points: market, participant, report_date, sequence, long_q, short_q.  age is 1
    for the latest report of a participant; newest is the market's latest report
    over all participants.
    """
    key = ["market", "participant"]
    latest = points.groupBy(*key, "report_date").agg(F.max_by(F.struct("long_q", "short_q"), "sequence").alias("p"))
    aged = latest.withColumn("age", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("report_date"))).cast("long")).where(F.col("age") <= weeks)
    newest = F.max("report_date").over(Window.partitionBy("market"))
    return aged.select(*key, "report_date", F.col("p.long_q").alias("long_q"), F.col("p.short_q").alias("short_q"), (F.col("p.long_q") - F.col("p.short_q")).alias("net"), "age", newest.alias("newest"))


def positioning_summary(points: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """One row a participant: its latest net, the change of a week, and the share of weeks that were not above it, in percent."""
    shown = positioning(points, weeks)
    key = ["market", "participant"]
    latest = shown.groupBy(*key, "newest").agg(F.max(F.when(F.col("age") == 1, F.col("net"))).alias("net"), F.max(F.when(F.col("age") == 2, F.col("net"))).alias("prior"))
    below = shown.select(*key, F.col("net").alias("each")).join(latest, key).groupBy(*key, "newest", "net", "prior").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("each") <= F.col("net"), 1)).alias("n_below"))
    return below.select(*key, "newest", "net", (F.col("net") - F.col("prior")).alias("change"), "n", F.round(100.0 * F.col("n_below") / F.col("n"), 6).alias("percentile"))


def release_tape(releases: DataFrame, keep: int = RELEASES) -> DataFrame:
    """The ``keep`` latest releases by (scheduled_ns, sequence), newest first; one release that is scheduled anew stands twice."""
    newest = releases.orderBy(F.desc("scheduled_ns"), F.desc("sequence")).limit(keep)
    # Only now numbered: ``keep`` rows.
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("scheduled_ns"), F.desc("sequence"))).cast("long"))


def board(series: DataFrame, releases: DataFrame, now_ns: Column) -> DataFrame:
    """One row: next_scheduled, current_series, corrected_series.

    series: series, period, sequence, corrected; a series counts as corrected by
    its latest period.  releases: scheduled_ns.
    """
    latest = series.groupBy("series").agg(F.max_by("corrected", F.struct("period", "sequence")).alias("corrected"))
    counted = latest.agg(F.count(F.lit(1)).alias("current_series"), F.count(F.when(F.col("corrected"), 1)).alias("corrected_series"))
    return counted.crossJoin(releases.where(F.col("scheduled_ns") >= now_ns).agg(F.min("scheduled_ns").alias("next_scheduled")))  # one row each


def by_category(series: DataFrame) -> DataFrame:
    """One row: how many series each category has."""
    names = ("inflation", "labor", "rates", "growth")
    return series.agg(*[F.count(F.when(F.col("category") == c, 1)).alias(c) for c in names])


def latest_provenance(points: DataFrame) -> DataFrame:
    """The point with the largest sequence over all series."""
    return points.agg(F.max(F.struct("sequence", "series", "period", "value")).alias("p")).where(F.col("p").isNotNull()).select("p.*")


def next_refresh(feeds: DataFrame, now_ns: int) -> DataFrame:
    """Each feed's next refresh, and whether it is the earliest: feed, last_ns, interval_ns; a feed never received is due now."""
    due = feeds.withColumn("next_ns", F.when(F.col("last_ns").isNull(), F.lit(now_ns)).otherwise(F.greatest(F.col("last_ns") + F.col("interval_ns"), F.lit(now_ns))))
    first = due.agg(F.min("next_ns").alias("first_ns"))  # one row
    return due.join(F.broadcast(first)).select("feed", "next_ns", (F.col("next_ns") == F.col("first_ns")).alias("earliest"))


def feed_states(catalogue: DataFrame, failures: DataFrame, published: DataFrame, received: DataFrame) -> DataFrame:
    """(feed, state, retry_ns): not configured over rejected over current over received but not published over awaiting.

    catalogue: feed, configured; failures: feed, retry_ns; published and received: rows with their feed.
    """
    fail = failures.groupBy("feed").agg(F.max("retry_ns").alias("retry_ns"))
    some = lambda df, name: df.select("feed").distinct().withColumn(name, F.lit(True))
    out = catalogue.join(fail, "feed", "left").join(some(published, "is_published"), "feed", "left").join(some(received, "is_received"), "feed", "left")
    failed = F.col("configured") & F.col("retry_ns").isNotNull()
    state = F.when(~F.col("configured"), "not_configured").when(failed, "rejected").when(F.col("is_published"), "current").when(F.col("is_received"), "rejected").otherwise("awaiting")
    return out.select("feed", state.alias("state"), F.when(failed, F.col("retry_ns")).otherwise(F.lit(0)).alias("retry_ns"))
