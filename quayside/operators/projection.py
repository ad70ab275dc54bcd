"""What a chart shows of the structure: lines and bands with labels, and fingerprints of snapshots and mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.structure import OPENING, PROJECTION, SESSION

#: Labels of the levels by producer and rank, styles and priorities of the producers.
SESSION_LABELS = ("CSH", "CSL", "D-U", "D-L", "PSH", "PSL")
OPENING_LABELS = ("ORH", "ORL", "ORM")
STYLES = {SESSION: ("boundary", 3), OPENING: ("boundary", 3), PROJECTION: ("range", 4)}


def level_rank(level_id: Column, family: Column) -> Column:
    """Which of its producer's levels one is, from its number: 0 to 5 for sessions (the first has four), 0 to 2 for opening ranges, 1 to 8 for projections."""
    number = level_id.bitwiseAND(F.lit((1 << 32) - 1))
    later = F.pmod(number - F.lit(5), F.lit(6))  # previous high, previous low, high, low, upper, lower
    session = F.when(number <= 4, number - 1).when(later < 2, later + 4).otherwise(later - 2)
    return F.when(family == SESSION, session).when(family == OPENING, F.pmod(number - 1, F.lit(3))).otherwise(number)


def label(level_id: Column, family: Column) -> Column:
    rank = level_rank(level_id, family)
    named = lambda names: F.element_at(F.array(*map(F.lit, names)), rank.cast("int") + 1)
    return F.when(family == SESSION, named(SESSION_LABELS)).when(family == OPENING, named(OPENING_LABELS)).otherwise(F.concat(F.lit("R"), (rank - 1).cast("string")))


def chart_structure(active: DataFrame) -> DataFrame:
    """The lines and bands of each generation in their order: inst, generation, shape, place, level_id, lower, upper, label, style, priority, frozen.

    active: inst, generation, level_id, lower, upper, family, state; bands are the
    levels whose edges differ in kind, which only sessions have.  Places count
    within one generation and shape, so what is sorted is as long as the list of
    active levels.
    """
    rank = level_rank(F.col("level_id"), F.col("family"))
    style = F.create_map(*[F.lit(x) for k, (s, _) in STYLES.items() for x in (k, s)])
    priority = F.create_map(*[F.lit(x) for k, (_, p) in STYLES.items() for x in (k, p)])
    band = (F.col("family") == SESSION) & rank.isin(2, 3)
    rows = active.withColumn("shape", F.when(band, "band").otherwise("line")).withColumn("priority", F.element_at(priority, F.col("family")))
    shown = F.struct("priority", "lower", "level_id", "upper", label(F.col("level_id"), F.col("family")).alias("label"), F.element_at(style, F.col("family")).alias("style"), (F.col("state") == "frozen").alias("frozen"))
    listed = rows.groupBy("inst", "generation", "shape").agg(F.sort_array(F.collect_list(shown)).alias("all"))
    out = listed.select("inst", "generation", "shape", F.posexplode("all").alias("i", "x"))
    return out.select("inst", "generation", "shape", (F.col("i") + 1).cast("long").alias("place"), *[F.col(f"x.{c}").alias(c) for c in ("level_id", "lower", "upper", "label", "style", "priority", "frozen")])


def fingerprint(rows: DataFrame, *, by: list[str], order: list[str], fields: list[str], tag: str) -> DataFrame:
    """(by, n, fingerprint): a digest of ``fields`` of all rows of a snapshot, in order; equal exactly where the snapshots are.

    Every field is written with its length, a null as a dash, so no two lists of
    values read the same.  A snapshot's rows meet in one task: they are as many as
    an instrument has active levels.
    """
    text = lambda c: F.col(c).cast("string")
    line = F.concat(*[F.when(F.col(c).isNull(), F.lit("-;")).otherwise(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c), F.lit(";"))) for c in fields])
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    return listed.select(*by, F.size("all").cast("long").alias("n"), F.sha2(F.concat(F.lit(f"{tag}\n"), F.size("all").cast("string"), F.lit("\n"), body), 256).alias("fingerprint"))
