"""Running values over a long order, cell by cell.

A window over a key that holds a large share of all rows runs in one task.
Here rows are cut into cells of their order (a session, a day, so many numbers):
inside a cell a window runs as usual, and what the cells before leave behind is
carried in from one row for each key and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running_max(rows: DataFrame, *, on: list[str], cell: str, order: list, value: Column, into: str) -> DataFrame:
    """``rows`` with the largest ``value`` of all earlier rows of the key; null without one.

    cell: a column that never falls along ``order``, within a key.
    """
    rows = rows.withColumn(into, value)
    carried = _carried(rows, on, cell, F.max(into), F.max("v"), into)
    inside = F.max(into).over(_before([*on, cell], order))
    found = rows.withColumn("__inside", inside)
    return _joined(found, carried, on, cell).withColumn(into, F.greatest("__inside", "__carried")).drop("__inside", "__carried")


def running_last(rows: DataFrame, *, on: list[str], cell: str, order: list, value: Column, into: str) -> DataFrame:
    """``rows`` with the latest ``value`` that is not null of all earlier rows of the key."""
    rows = rows.withColumn(into, value)
    by = F.struct(*order)
    carried = _carried(rows, on, cell, F.max_by(into, F.when(F.col(into).isNotNull(), by)), F.last("v", ignorenulls=True), into)
    inside = F.last(into, ignorenulls=True).over(_before([*on, cell], order))
    found = rows.withColumn("__inside", inside)
    return _joined(found, carried, on, cell).withColumn(into, F.coalesce("__inside", "__carried")).drop("__inside", "__carried")


def running_sum(rows: DataFrame, *, on: list[str], cell: str, order: list, value: Column, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all earlier rows of the key; 0 for the first."""
    rows = rows.withColumn(into, value)
    carried = _carried(rows, on, cell, F.sum(into), F.sum("v"), into)
    inside = F.sum(into).over(_before([*on, cell], order))
    found = rows.withColumn("__inside", inside)
    zero = F.lit(0).cast("long")
    return _joined(found, carried, on, cell).withColumn(into, F.coalesce("__inside", zero) + F.coalesce("__carried", zero)).drop("__inside", "__carried")


def running_rank(rows: DataFrame, *, cell: str, order: list, into: str, on: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` numbered from 1 along ``order``, over all rows of the key, or all rows without one."""
    keys = [*on, cell]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(*keys, F.coalesce(F.sum("n").over(_before(list(on), [cell])), F.lit(0)).alias("__start"))  # a row for each cell
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(into, inside).join(starts, keys).withColumn(into, F.col(into) + F.col("__start")).drop("__start")


def _carried(rows: DataFrame, on: list[str], cell: str, of_cell: Column, over_cells: Column, into: str) -> DataFrame:
    cells = rows.groupBy(*on, cell).agg(of_cell.alias("v"))
    return cells.select(*on, cell, over_cells.over(_before(on, [cell])).alias("__carried"))


def _joined(found: DataFrame, carried: DataFrame, on: list[str], cell: str) -> DataFrame:
    return found.join(carried, [*on, cell], "left")


def with_lead_in(rows: DataFrame, *, on: list[str], cell: str, order: str, n: int) -> DataFrame:
    """``rows`` with those of the cells before that a window of ``n`` rows can reach, marked by ``lead_in``, in the later cell.

    A window over (key, cell) then sees what one over the key would, for every
    row that is not marked.  Cells are looked back until ``n`` rows are found:
    each cell's last rows are numbered from its end, so only rows that can be
    reached are copied.
    """
    from_end = F.row_number().over(Window.partitionBy(*on, cell).orderBy(F.desc(order)))
    tails = rows.withColumn("__from_end", from_end).where(F.col("__from_end") <= n)
    sizes = rows.groupBy(*on, cell).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*on).orderBy(cell)
    # Of each cell: the cells after it that its last row reaches, with how many rows lie between.
    later = F.collect_list(F.struct(F.col(cell).alias("to"), F.col("__n").alias("n"))).over(w.rowsBetween(1, n))
    reach = sizes.select(*on, cell, later.alias("__later"))
    step = F.aggregate(
        "__later",
        F.struct(F.lit(0).cast("long").alias("between"), F.array().cast(f"array<struct<to:{rows.schema[cell].dataType.simpleString()},between:bigint>>").alias("found")),
        lambda s, x: F.struct((s["between"] + x["n"]).alias("between"), F.when(s["between"] < n, F.concat(s["found"], F.array(F.struct(x["to"].alias("to"), s["between"].alias("between"))))).otherwise(s["found"]).alias("found")),
        lambda s: s["found"],
    )
    copied = tails.join(reach, [*on, cell]).select(*rows.columns, "__from_end", F.explode(step).alias("__to")).where(F.col("__from_end") + F.col("__to.between") <= n)
    copied = copied.withColumn(cell, F.col("__to.to")).select(*rows.columns, F.lit(True).alias("lead_in"))
    return rows.withColumn("lead_in", F.lit(False)).unionByName(copied)
