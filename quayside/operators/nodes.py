"""Nodes of price levels: clusters of each generation, and which node of the last one they continue.

A generation is the set of an instrument's active levels after one change of the
book.  Its levels are taken in order of lower edge, upper edge, price and id; a
level joins the youngest cluster that lies within the merge threshold and that
holds neither a level of its exclusive group nor, against an upper boundary, a
lower one.  Generations are clustered apart from each other, in parallel: one
row holds one generation, whose size is that of the active levels, not of the
history.

Identity is a chain through all generations of an instrument, worked out in
parallel.  Generations are cut into blocks of ``BLOCK``.  Which cluster continues
which depends on the clusters of two neighbouring generations, and only in a tie
on which node is the older one; so every block is folded by itself, with its
first nodes known by place only.  Each block then says where the nodes of its
last generation come from: from a place in the block before, or from a birth of
its own.  Pointer doubling over blocks leads every place to its birth in as many
rounds as the logarithm of the number of blocks, and births are numbered by
counts of the blocks before.  A block whose ties were decided by an order that
turns out otherwise is folded again, until none is left: then every block has
met the order that its predecessors gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quayside.functions.scalars import merge_threshold, whole_quotient
from quayside.operators.sequences import running_rank, running_sum
from quayside.sources.shared import written

__all__ = ["cluster", "clusters", "corridors", "genealogy", "locate", "merge_threshold"]

LOWER, CENTER, UPPER, NEUTRAL = -1, 1, 2, 0
CLUSTER = "low bigint, high bigint, center bigint, sides array<int>, members array<bigint>"


def gap_between(low_a: int, high_a: int, low_b: int, high_b: int) -> int:
    return max(low_b - high_a, low_a - high_b, 0)


def _opposed(sides: set[int], side: int) -> bool:
    return (side == LOWER and UPPER in sides) or (side == UPPER and LOWER in sides)


def cluster(levels: list, threshold: int) -> list[dict]:
    """levels: (lower, upper, price, level_id, group_id, side) of one generation, in order."""
    out: list[dict] = []
    for lower, upper, price, level_id, group, side in levels:
        for c in reversed(out):
            if gap_between(c["low"], c["high"], lower, upper) <= threshold and not (group and group in c["groups"]) and not _opposed(c["sides"], side):
                c["low"], c["high"] = min(c["low"], lower), max(c["high"], upper)
                c["center"] = c["low"] + (c["high"] - c["low"]) // 2
                break
        else:
            c = {"low": lower, "high": upper, "center": price, "groups": set(), "sides": set(), "members": []}
            out.append(c)
        c["groups"].add(group)
        c["sides"].add(side)
        c["members"].append(level_id)
    out.sort(key=lambda c: (c["center"], c["low"], c["high"]))
    return [{"low": c["low"], "high": c["high"], "center": c["center"], "sides": sorted(c["sides"]), "members": sorted(c["members"])} for c in out]


def clusters(levels: DataFrame) -> DataFrame:
    """(inst, generation, at_ns, threshold, clusters) of every generation.

    levels: inst, generation, at_ns, threshold, level_id, lower, upper, price,
    group_id (0: none), side (LOWER, UPPER, CENTER, NEUTRAL); one row for each
    active level of a generation.
    """
    each = F.struct("lower", "upper", "price", "level_id", "group_id", "side")
    listed = levels.groupBy("inst", "generation", "at_ns", "threshold").agg(F.sort_array(F.collect_list(each)).alias("levels"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [cluster([tuple(x[k] for k in ("lower", "upper", "price", "level_id", "group_id", "side")) for x in ls], t) for ls, t in zip(rows["levels"], rows["threshold"], strict=True)]
            yield rows[["inst", "generation", "at_ns", "threshold"]].assign(clusters=found)

    return listed.mapInPandas(run, f"inst bigint, generation bigint, at_ns bigint, threshold bigint, clusters array<struct<{CLUSTER.replace(' ', ':').replace(',:', ',')}>>")


NODE = "node:bigint,low:bigint,high:bigint,center:bigint,sides:array<int>,members:array<bigint>,created_ns:bigint,updated_ns:bigint"
EVENT = "event:string,node:bigint,others:array<bigint>"
CHAIN = f"inst bigint, generation bigint, nodes array<struct<{NODE}>>, events array<struct<{EVENT}>>"


#: Generations that one task folds as a whole.
BLOCK = 256


class Chain:
    """The nodes of the last generation and the number of the next new one.

    nodes: clusters with node and created_ns; number: of the next node born;
    known: ids below it stand for places whose order is only assumed.
    """

    def __init__(self, inst: int, nodes: list[dict], number: int, known: int = 0):
        self.inst, self.nodes, self.number, self.known = inst, nodes, number, known
        self.tied, self.born = False, []

    def _heirs(self, found: list[dict], threshold: int) -> tuple[list[list[int]], list[list[int]]]:
        """Of each cluster: the levels that it shares with every node, and the nodes it may continue."""
        shared = [[len(set(c["members"]).intersection(p["members"])) for p in self.nodes] for c in found]
        near = lambda c, p: gap_between(c["low"], c["high"], p["low"], p["high"]) <= threshold and not any(_opposed(set(p["sides"]), s) for s in c["sides"])
        return shared, [[k for k, p in enumerate(self.nodes) if n[k] or near(c, p)] for c, n in zip(found, shared, strict=True)]

    def step(self, found: list[dict], at_ns: int, threshold: int) -> tuple[list[dict], list[dict]]:
        """The nodes of the next generation, in the order of ``found``, and what became of the last ones."""
        last = self.nodes
        shared, related = self._heirs(found, threshold)
        free, nodes = set(range(len(last))), []
        for c, n, ks in zip(found, shared, related, strict=True):
            fit = sorted((-n[k], abs(c["center"] - last[k]["center"]), last[k]["node"], k) for k in ks if k in free)
            alike = [f for f in fit if f[:2] == fit[0][:2]]
            self.tied |= sum(f[2] < self.known for f in alike) > 1
            if fit:
                free.discard(fit[0][3])
                nodes.append(c | {"node": fit[0][2], "created_ns": last[fit[0][3]]["created_ns"], "updated_ns": at_ns})
            else:
                nodes.append(c | {"node": None, "created_ns": at_ns, "updated_ns": at_ns})
        for node in nodes:
            if node["node"] is None:
                node["node"] = (self.inst << 32) | (self.number & 0xFFFFFFFF)
                self.number += 1
                self.born.append(at_ns)
        events = []
        for node, ks in zip(nodes, related, strict=True):
            kind = "created" if not ks else "merged" if len(ks) > 1 else "preserved"
            events.append({"event": kind, "node": node["node"], "others": sorted({last[k]["node"] for k in ks} - {node["node"]}) if kind == "merged" else []})
        for k, p in enumerate(last):
            heirs = [node["node"] for node, ks in zip(nodes, related, strict=True) if k in ks]
            if len(heirs) != 1:
                events.append({"event": "split" if heirs else "expired", "node": p["node"], "others": heirs})
        self.nodes = nodes
        return nodes, events


_LINK = "inst bigint, block bigint, assumed array<int>, tied boolean, born array<bigint>, exits array<struct<born:boolean,at:int>>"


def _arrow(names: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(names))


def _blocks(generations: DataFrame) -> DataFrame:
    """(inst, block, steps): ``BLOCK`` generations each, in order, after the last one of the block before."""
    numbered = running_rank(generations.withColumn("__cell", F.expr(f"generation div {BLOCK}")), on=("inst",), cell="__cell", order=["generation"], into="step").drop("__cell")
    numbered = numbered.withColumn("step", F.col("step").cast("long") - 1)
    own = numbered.withColumn("block", F.expr(f"step div {BLOCK}"))
    lead = own.where(F.col("step") % BLOCK == BLOCK - 1).withColumn("block", F.col("block") + 1)
    each = F.struct("step", "generation", "at_ns", "threshold", "clusters")
    return own.unionByName(lead).groupBy("inst", "block").agg(F.sort_array(F.collect_list(each)).alias("steps")).where(F.element_at("steps", -1)["step"] >= F.col("block") * BLOCK)


def _links(blocks: DataFrame) -> DataFrame:
    """Where the nodes at the end of each block come from; blocks: with ``assumed``, the order by age of the nodes it begins with (null: as they stand)."""
    kind = _arrow(_LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                steps, nodes, assumed = r["steps"], [], []
                if r["block"]:
                    first, steps = steps[0], steps[1:]
                    assumed = r["assumed"] or list(range(len(first["clusters"])))
                    nodes = [c | {"node": age, "created_ns": 0} for c, age in zip(first["clusters"], assumed, strict=True)]
                chain = Chain(0, nodes, len(nodes), known=len(nodes))
                for s in steps:
                    chain.step(s["clusters"], s["at_ns"], s["threshold"])
                place = {age: i for i, age in enumerate(assumed)}
                exits = [{"born": n["node"] >= chain.known, "at": n["node"] - chain.known if n["node"] >= chain.known else place[n["node"]]} for n in chain.nodes]
                out.append({"inst": r["inst"], "block": r["block"], "assumed": assumed, "tied": chain.tied, "born": chain.born, "exits": exits})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return blocks.select("inst", "block", "assumed", "steps").mapInArrow(run, _LINK)


def _births(links: DataFrame) -> DataFrame:
    """(inst, block, i, from_block, from_birth): the birth that each node at the end of a block goes back to.

    Every round doubles the number of blocks that a pointer leaps over.
    """
    places = links.select("inst", "block", F.posexplode("exits").alias("i", "x"))
    start = places.select("inst", "block", "i", F.when(F.col("x.born"), F.col("block")).otherwise(F.col("block") - 1).alias("to_block"), F.col("x.at").alias("to"), F.col("x.born").alias("done"))
    state = written(start, "nodes-leaps")
    while not (open_ := state.where(~F.col("done"))).isEmpty():
        target = state.select("inst", F.col("block").alias("to_block"), F.col("i").alias("to"), F.col("to_block").alias("next_block"), F.col("to").alias("next"), F.col("done").alias("next_done"))
        leapt = open_.join(target, ["inst", "to_block", "to"]).select("inst", "block", "i", F.col("next_block").alias("to_block"), F.col("next").alias("to"), F.col("next_done").alias("done"))
        state = written(state.where("done").unionByName(leapt), "nodes-leaps")
    return state.select("inst", "block", "i", F.col("to_block").alias("from_block"), F.col("to").alias("from_birth"))


def _entries(links: DataFrame) -> DataFrame:
    """(inst, block, first, entries): the number of a block's first birth, and number and time of birth of the nodes that it begins with."""
    counted = links.select("inst", "block", "born", F.size("born").cast("long").alias("n"), F.expr(f"block div {BLOCK}").alias("__cell"))
    before = running_sum(counted, on=["inst"], cell="__cell", order=["block"], value=F.col("n"), into="before").select("inst", "block", "born", (F.col("before") + 1).alias("first"))
    origin = before.select("inst", F.col("block").alias("from_block"), "born", F.col("first").alias("from_first"))
    found = _births(links).join(origin, ["inst", "from_block"])
    node = F.struct("i", (F.col("from_first") + F.col("from_birth")).alias("number"), F.element_at("born", F.col("from_birth") + 1).alias("created_ns"))
    listed = found.groupBy("inst", (F.col("block") + 1).alias("block")).agg(F.sort_array(F.collect_list(node)).alias("entries"))
    return before.drop("born").join(listed, ["inst", "block"], "left")


def genealogy(generations: DataFrame) -> DataFrame:
    """(inst, generation, nodes, events) from the result of ``clusters``.

    A cluster continues that free node of the last generation with which it
    shares the most levels, then the nearest, then the oldest.  events tell
    which nodes were created, preserved, merged, split and expired.
    """
    blocks = written(_blocks(generations), "nodes-blocks")
    none = F.lit(None).cast("array<int>")
    links = written(_links(blocks.withColumn("assumed", none)), "nodes-links")
    while True:
        entries = written(_entries(links), "nodes-entries")
        age = lambda e, all_: F.size(F.filter(all_, lambda o: o["number"] < e["number"]))
        ages = entries.select("inst", "block", F.transform("entries", lambda e: age(e, F.col("entries"))).alias("ages"))
        wrong = links.where("tied").join(ages, ["inst", "block"]).where(F.col("ages") != F.col("assumed")).select("inst", "block", F.col("ages").alias("assumed"))
        if wrong.isEmpty():
            break
        again = _links(blocks.join(wrong, ["inst", "block"]))
        links = written(links.join(wrong.select("inst", "block"), ["inst", "block"], "left_anti").unionByName(again), "nodes-links")
    kind = _arrow(CHAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                steps, nodes, out = r["steps"], [], []
                if r["block"]:
                    first, steps = steps[0], steps[1:]
                    nodes = [c | {"node": (r["inst"] << 32) | (e["number"] & 0xFFFFFFFF), "created_ns": e["created_ns"]} for c, e in zip(first["clusters"], r["entries"] or [], strict=True)]
                chain = Chain(r["inst"], nodes, r["first"])
                for s in steps:
                    made, events = chain.step(s["clusters"], s["at_ns"], s["threshold"])
                    made = sorted(made, key=lambda n: (n["center"], n["low"], n["high"], n["node"]))
                    out.append({"inst": r["inst"], "generation": s["generation"], "nodes": made, "events": events})
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return blocks.join(entries, ["inst", "block"]).select("inst", "block", "first", "entries", "steps").mapInArrow(run, CHAIN)


def corridors(nodes: DataFrame, atr: str = "atr") -> DataFrame:
    """(inst, generation, lower_node, upper_node, lower_edge, upper_edge, width, width_ppm) between neighbours of ``nodes`` and the average range ``atr``."""
    from quayside.functions.scalars import ratio_ppm

    ns = F.col("nodes")
    pairs = F.transform(F.sequence(F.lit(1), F.size(ns) - 1), lambda i: F.struct(F.element_at(ns, i).alias("a"), F.element_at(ns, i + 1).alias("b")))
    rows = nodes.where(F.size(ns) > 1).select("inst", "generation", atr, F.inline(pairs))
    width = F.greatest(F.col("b.low") - F.col("a.high"), F.lit(0).cast("long"))
    return rows.select("inst", "generation", F.col("a.node").alias("lower_node"), F.col("b.node").alias("upper_node"), F.col("a.high").alias("lower_edge"), F.col("b.low").alias("upper_edge"), width.alias("width"), ratio_ppm(width, F.col(atr)).alias("width_ppm"))


def locate(priced: DataFrame, price: str = "px", atr: str | None = None) -> DataFrame:
    """``priced`` (with a column ``nodes`` of one generation) and where the price stands: place, lower_node, upper_node, to_lower, to_upper.

    Inside a node (the narrowest, then the oldest) both are that node; else the
    neighbours by center.  Without nodes the place is ``unavailable``.  With the
    column ``atr`` of the average range, to_lower_ppm and to_upper_ppm are the
    distances in millionths of it; null where it is not positive.
    """
    px, ns = F.col(price), F.col("nodes")
    zero = F.lit(0).cast("long")
    holding = F.filter(ns, lambda n: (px >= n["low"]) & (px <= n["high"]))
    inside = F.array_min(F.transform(holding, lambda n: F.struct((n["high"] - n["low"]).alias("w"), n["node"].alias("node"), n["low"].alias("low"), n["high"].alias("high"))))
    below = F.filter(ns, lambda n: n["center"] < px)
    above = F.filter(ns, lambda n: n["center"] >= px)
    under, over = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    place = F.when(F.coalesce(F.size(ns), F.lit(0)) == 0, "unavailable").when(inside.isNotNull(), "inside").when(under.isNull(), "below").when(over.isNull(), "above").otherwise("between")
    out = (
        priced.withColumn("place", place)
        .withColumn("lower_node", F.coalesce(inside["node"], under["node"]))
        .withColumn("upper_node", F.coalesce(inside["node"], over["node"]))
        .withColumn("to_lower", F.when(inside.isNotNull(), px - inside["low"]).when(under.isNotNull(), F.greatest(px - under["high"], zero)))
        .withColumn("to_upper", F.when(inside.isNotNull(), inside["high"] - px).when(over.isNotNull(), F.greatest(over["low"] - px, zero)))
    )
    if atr is None:
        return out
    share = lambda c: F.when(F.col(atr) > 0, whole_quotient(F.col(c) * 1_000_000, F.col(atr)))
    return out.withColumn("to_lower_ppm", share("to_lower")).withColumn("to_upper_ppm", share("to_upper"))
