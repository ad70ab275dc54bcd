"""Joins on validity intervals and on the latest earlier row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(events: DataFrame, spans: DataFrame, *, on: list[str], at: str, start: str, end: str, cell: int, how: str = "inner") -> DataFrame:
    """Each event with the spans [start, end) of its key that hold its time.

    Spans are listed once for every cell of ``cell`` time units that they
    touch, so the join is an equi-join on key and cell that Spark can broadcast,
    sort or split by skew, and not a nested loop.  Choose cells about as long as
    a usual span.  An event whose time is null meets nothing.
    """
    mark = "__interval_cell"
    first, last = F.floor(F.col(start) / cell).cast("long"), F.floor((F.col(end) - 1) / cell).cast("long")
    listed = spans.where(F.col(start) < F.col(end)).withColumn(mark, F.explode(F.sequence(first, last)))
    placed = events.withColumn(mark, F.floor(F.col(at) / cell).cast("long"))
    keys = [*on, mark]
    match = [placed[k] == listed[k] for k in keys] + [placed[at] >= listed[start], placed[at] < listed[end]]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return placed.join(listed, condition, how).select(*[placed[c] for c in events.columns], *[listed[c] for c in spans.columns if c not in on])


def overlaps(spans: DataFrame, *, on: list[str], start: str, end: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Spans that begin before an earlier span of their key has ended.

    Spans are taken by start, then by end, unknown ones last.  Which of several
    with the same start and end comes first shows in ``prior_end``; columns
    ``by`` decide it, without which it is open.
    """
    w = Window.partitionBy(*on).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end), *map(F.asc_nulls_last, by))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("prior_end", before).where(F.col("prior_end") > F.col(start))


def asof_join(left: DataFrame, right: DataFrame, *, on: list[str], left_at: str, right_at: str, take: list[str], cell: int) -> DataFrame:
    """Each left row with ``take`` of the latest right row of its key that is not later; null without one.

    Both sides are dealt by key and cell of ``cell`` time units, so one busy key
    is spread over many tasks.  Inside a cell, one sort by time finds the latest
    right row; where a cell has none yet, the last one of the cells before is
    carried in, from one row per key and cell.  Of right rows at the same time
    the one with the largest values counts.  A left row whose time is null
    meets nothing.
    """
    packed = right.select(F.struct(*take).alias("x")).schema["x"].dataType
    at_cell = F.floor(F.col("at") / cell).cast("long")
    lefts = left.select(F.struct(*left.columns).alias("row"), *on, F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(packed).alias("packed")).withColumn("cell", at_cell)
    rights = right.where(F.col(right_at).isNotNull()).select(F.lit(None).cast(lefts.schema["row"].dataType).alias("row"), *on, F.col(right_at).alias("at"), F.lit(0).alias("side"), F.struct(*take).alias("packed")).withColumn("cell", at_cell)
    inside = Window.partitionBy(*on, "cell").orderBy("at", "side", "packed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = lefts.unionByName(rights).withColumn("found", F.when(F.col("cell").isNotNull(), F.last("packed", ignorenulls=True).over(inside))).where(F.col("side") == 1)
    latest = rights.groupBy(*on, "cell").agg(F.max(F.struct("at", "packed")).alias("latest"))
    cells = lefts.select(*on, "cell").where(F.col("cell").isNotNull()).distinct().join(latest, [*on, "cell"], "full")
    before = Window.partitionBy(*on).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*on, "cell", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    out = found.join(carried, [*on, "cell"], "left").withColumn("found", F.coalesce("found", "carried.packed"))
    return out.select("row.*", *[F.col(f"found.{c}").alias(f"asof_{c}") for c in take])


def missing(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``expected`` that ``actual`` lacks: a refresh is complete when there are none."""
    return expected.join(actual, on, "left_anti")
