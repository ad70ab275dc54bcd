"""The book of price levels as a log of mutations, read by windows.

A mutation is (inst, generation, ordinal, kind, level_id) with the level's
values after it.  Kinds are created, updated, frozen, expired and superseded.
A level develops while it is updated, may be frozen, and ends when it expires
or is superseded.  What state a mutation meets is what the mutation before it
left, in the level's own log: levels are judged in parallel, a long log in
cells, and no task holds a book.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quayside.operators.sequences import running_last
from quayside.sources.shared import written

LIVE = ("created", "updated", "frozen")


def _log():
    return Window.partitionBy("inst", "level_id").orderBy("generation", "ordinal")


#: Generations whose rows one window sees, or one task folds; what earlier ones leave is carried in.
CELL = 4096


def _nameless() -> Column:
    return (F.coalesce("level_id", F.lit(0)) == 0) | (F.coalesce("inst", F.lit(0)) == 0)


def _misshapen() -> Column:
    return F.col("kind").isin("created", "updated") & ~F.coalesce((F.col("lower") <= F.col("price")) & (F.col("price") <= F.col("upper")), F.lit(False))


def _met(mutations: DataFrame, refused: DataFrame | None) -> DataFrame:
    """``mutations`` with ``met``: kind, family and side of the mutation before, of the level's own log, leaving out what other refused generations hold.

    The state a log leaves is that of its last mutation that counts, which
    composes over stretches of the log: cells are reduced apart and carried on.
    """
    own = F.struct("kind", "family", "side")
    counts = F.lit(True) if refused is None else F.col("__refused").isNull()
    rows = mutations.withColumn("__cell", F.expr(f"generation div {CELL}"))
    if refused is not None:
        rows = rows.join(refused.withColumn("__refused", F.lit(True)), ["inst", "generation"], "left")
    rows = rows.withColumn("__own", F.lag(own).over(Window.partitionBy("inst", "level_id", "generation").orderBy("ordinal")))
    rows = running_last(rows, on=["inst", "level_id"], cell="__cell", order=["generation", "ordinal"], value=F.when(counts, own), into="__left")
    return rows.withColumn("met", F.coalesce("__own", "__left")).drop("__cell", "__own", "__left", "__refused")


def violations(mutations: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """(inst, generation, level_id, rule): generations with a row here must not be applied, whole.

    refused: (inst, generation) of generations that are known to leave nothing behind.
    """
    before = F.col("met.kind")
    ended = before.isin("expired", "superseded")
    drift = F.coalesce((F.col("family") != F.col("met.family")) | (F.col("side") != F.col("met.side")), F.lit(False))
    rules = F.array(
        F.when(_nameless(), F.lit("missing identity")),
        F.when((F.col("kind") == "created") & before.isNotNull(), F.lit("duplicate identity")),
        F.when((F.col("kind") != "created") & before.isNull(), F.lit("unknown identity")),
        F.when((F.col("kind").isin("updated", "frozen") & (ended | (before == "frozen"))) | (F.col("kind").isin("expired", "superseded") & ended), F.lit("immutable identity")),
        F.when((F.col("kind") == "updated") & drift, F.lit("identity drift")),
        F.when(_misshapen(), F.lit("geometry")),
    )
    return _met(mutations, refused).select("inst", "generation", "level_id", F.explode(F.array_compact(rules)).alias("rule"))


def _breaks(kind: str | None, family: int | None, side: int | None, met: tuple | None) -> bool:
    """Whether a mutation may not follow what it met; the rules are those of ``violations``."""
    before, *was = met or (None, None, None)
    if kind is None:
        return False
    if kind == "created" or before is None:
        return (kind == "created") == (before is not None)
    ended = before in ("expired", "superseded")
    drift = kind == "updated" and any(a is not None and b is not None and a != b for a, b in zip((family, side), was, strict=True))
    return drift or kind in ("updated", "frozen") and (ended or before == "frozen") or kind in ("expired", "superseded") and ended


def _fold(log: DataFrame, entries: DataFrame) -> DataFrame:
    """(inst, cell, generation, level_id, left): generations that the book refuses, and what each cell leaves of each level of ``entries``.

    entries: inst, cell, level_id, met; a level is refused and left null where no mutation of the cell is applied.
    """
    of = lambda name: StructField(name, log.schema[name].dataType)
    left = StructField("left", StructType([of("kind"), of("family"), of("side")]))
    out = StructType([of("inst"), entries.schema["cell"], of("generation"), of("level_id"), left])
    kind = to_arrow_schema(out)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        inst, cell = (k.as_py() for k in key)
        columns = rows.sort_by([("generation", "ascending"), ("ordinal", "ascending")]).to_pydict()
        each = list(zip(*(columns[c] for c in ("generation", "level_id", "kind", "family", "side", "bad", "entry")), strict=True))
        book, fresh, refused = {r[1]: r[2:5] for r in each if r[6]}, {}, []
        for generation, mutations in groupby((r for r in each if not r[6]), lambda r: r[0]):
            state, ok = {}, True
            for _, level, *now, bad, _ in mutations:
                ok = ok and not bad and not _breaks(*now, state.get(level) or fresh.get(level) or book.get(level))
                state[level] = now
            if ok:
                fresh |= state
            else:
                refused.append(generation)
        leaves = [(level, dict(zip(("kind", "family", "side"), fresh[level], strict=True)) if level in fresh else None) for level in book]
        n, m = len(refused), len(leaves)
        values = [[inst] * (n + m), [cell] * (n + m), refused + [None] * m, [None] * n + [x[0] for x in leaves], [None] * n + [x[1] for x in leaves]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, kind, strict=True)], schema=kind)

    rows = log.where(F.col("generation").isNotNull()).select("inst", "cell", "generation", "ordinal", "level_id", "kind", "family", "side", (_nameless() | _misshapen()).alias("bad"), F.lit(False).alias("entry"))
    carried = entries.select("inst", "cell", "level_id", "met.*", F.lit(True).alias("entry"))
    return rows.unionByName(carried, allowMissingColumns=True).groupBy("inst", "cell").applyInArrow(run, out)


def _folded(log: DataFrame, refused: DataFrame) -> DataFrame:
    """(inst, generation) of the refused generations, by cells that are each folded from what the cells before leave.

    At first that is what they leave if just ``refused`` are; a cell that was
    folded from something else than it turns out is folded again, until none is
    left: then every cell has met what the cells before it leave.  Only levels
    with mutations in several cells are carried, and only cells that rest on a
    changed one are folded twice.
    """
    log = log.withColumn("cell", F.expr(f"generation div {CELL}"))
    level, cell = Window.partitionBy("inst", "level_id"), ["inst", "cell"]
    before = level.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    marked = log.join(refused.withColumn("__refused", F.lit(True)), ["inst", "generation"], "left")
    own = F.when(F.col("__refused").isNull(), F.struct("kind", "family", "side"))
    left = marked.groupBy(*cell, "level_id").agg(F.max_by(own, F.when(own.isNotNull(), F.struct("generation", "ordinal"))).alias("left"))
    left = written(left.withColumn("__n", F.count(F.lit(1)).over(level)).where("__n > 1").drop("__n"), "levels-left")
    known = found = None
    while True:
        entries = written(left.withColumn("met", F.last("left", ignorenulls=True).over(before)), "levels-entries")
        if known is None:
            out = written(_fold(log, entries), "levels-folded")
            found = out
        else:
            other = entries.join(known.withColumnRenamed("met", "was"), [*cell, "level_id"]).where(~F.col("met").eqNullSafe(F.col("was")))
            wrong = written(other.select(*cell).distinct(), "levels-wrong")
            if wrong.isEmpty():
                return found.where(F.col("generation").isNotNull()).select("inst", "generation")
            again = lambda df: df.join(F.broadcast(wrong), cell, "left_semi")
            out = _fold(again(log), again(entries))
            found = written(found.join(F.broadcast(wrong), cell, "left_anti").unionByName(out), "levels-folded")
        known, left = entries.select(*cell, "level_id", "met"), found.where(F.col("generation").isNull()).select(*cell, "level_id", "left")


def _refusals(log: DataFrame) -> DataFrame:
    """``refusals`` of a log that is read more than once."""
    judged = lambda refused: written(violations(log, refused).select("inst", "generation").distinct(), "levels-refused")
    refused = written(_folded(log, judged(None)), "levels-refused")
    while True:
        now = judged(refused)
        if now.exceptAll(refused).isEmpty() and refused.exceptAll(now).isEmpty():
            return now
        refused = now


def refusals(mutations: DataFrame) -> DataFrame:
    """(inst, generation) of the generations that the book refuses, each whole, when it applies the log in order.

    Refusals may rest on one another in long chains, so cells of the log are
    folded first, each in one task (``_folded``).  Then all generations are judged
    at once against what those that are not refused leave.  A verdict is right
    once those of all earlier generations it rests on are, so refusals that
    repeat themselves are right; the first do unless a level has two mutations of
    one ordinal in a generation, whose order is open.
    """
    return _refusals(written(mutations, "levels-log"))


def applied(mutations: DataFrame) -> DataFrame:
    """The log without the generations that the book refuses."""
    log = written(mutations, "levels-log")
    return log.join(_refusals(log), ["inst", "generation"], "left_anti")


def sequence_breaks(mutations: DataFrame) -> DataFrame:
    """(inst, generation, expected) where an instrument's generations do not count up by one from 1."""
    w = Window.partitionBy("inst").orderBy("generation")
    steps = mutations.select("inst", "generation").distinct().withColumn("expected", F.coalesce(F.lag("generation").over(w), F.lit(0)) + 1)
    return steps.where("generation <> expected")


def versions(mutations: DataFrame) -> DataFrame:
    """Each version of a level with [from_generation, to_generation), where it is active; an open end is null.

    Of several mutations of a level in one generation the last counts; frozen
    levels keep their values and stay active.  age counts the level's updates.
    """
    final = F.row_number().over(Window.partitionBy("inst", "level_id", "generation").orderBy(F.desc("ordinal"))) == 1
    age = F.sum((F.col("kind") == "updated").cast("long")).over(_log())
    keep = lambda c: F.last(F.when(F.col("kind").isin("created", "updated"), F.col(c)), ignorenulls=True).over(_log())
    filled = mutations.select("inst", "generation", "ordinal", "level_id", "kind", *[keep(c).alias(c) for c in ("lower", "upper", "price", "group_id", "side", "family")], age.alias("age"))
    last = filled.withColumn("__final", final).where("__final").drop("__final")
    ends = F.lead("generation").over(Window.partitionBy("inst", "level_id").orderBy("generation"))
    out = last.withColumn("to_generation", ends).where(F.col("kind").isin(*LIVE))
    return out.withColumnRenamed("generation", "from_generation").drop("ordinal").withColumn("state", F.when(F.col("kind") == "frozen", "frozen").otherwise("developing")).drop("kind")


def active(versions_: DataFrame, generations: DataFrame) -> DataFrame:
    """The active levels of every generation: generations (inst, generation, ...) with each version that is valid then."""
    newest = generations.groupBy("inst").agg(F.max("generation").alias("newest"))
    spans = versions_.join(newest, "inst")
    until = F.coalesce(F.col("to_generation") - 1, F.col("newest"))
    spread = spans.withColumn("generation", F.explode(F.sequence("from_generation", until))).drop("from_generation", "to_generation", "newest")
    return spread.join(generations, ["inst", "generation"])
