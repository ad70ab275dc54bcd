"""A Merkle manifest of a table, its trees stored in van Emde Boas order.

Every row is a leaf: the hash of its columns.  Leaves of one group (a source)
stand in order of their id; while several nodes remain, every ``ARITY``
consecutive ones become their hash.  The groups' roots, in order of the group,
are the leaves of one more tree, whose root stands for the table.

A tree is built in aligned blocks of ``BLOCK_LEVELS`` levels.  A block of leaves
is one row, built in a task; the blocks' roots are numbered as their blocks are,
so they are the leaves of the next round, until a tree has one block.  A block
keeps its nodes in van Emde Boas order: its height is cut in half, the upper
subtree comes first, then each lower one whole, and each of them likewise.
``address`` is that order's arithmetic; construction and the retrieval of
siblings both go by it.  Proofs run the other way: what stands beside a block's
root on its way to the top is handed down to the block, whose rows then read
only the block itself.

No task holds a tree: ranks come from rows sorted in ranges and from counts by
range, so a group of any size is split, and a block has at most
``ARITY ** BLOCK_LEVELS`` leaves.

Defined results: a null column is hashed as ``-``; a null group is one of its own
and comes first; null ids come first in their group; rows of one id stand in
order of their hash, so repeated rows are leaves beside each other; a row is
tampered with only if its id is not null; an empty table gives an empty result;
columns other than the five are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import stored

ARITY = 16
#: Levels of hashing inside a block.
BLOCK_LEVELS = 3
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_WHOLE = "whole"
_SIDES = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree_size(levels: int) -> int:
    """Nodes of a full tree with so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where nodes ``index`` of ``depth`` (the root's is 0) stand in a tree with so many levels of nodes."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, width = levels - upper, ARITY ** (depth - upper)
    return tree_size(upper) + index // width * tree_size(lower) + address(lower, depth - upper, index % width)


def built(leaves: list[str], height: int) -> list[str | None]:
    """The nodes of a block in van Emde Boas order, up to the last one used."""
    places = [address(height + 1, d, np.arange(-(-len(leaves) // ARITY ** (height - d)))) for d in range(height + 1)]
    nodes: list[str | None] = [None] * (1 + max(int(p.max()) for p in places))
    for at, leaf in zip(places[height], leaves, strict=True):
        nodes[at] = leaf
    for d in range(height - 1, -1, -1):
        below = places[d + 1]
        for i, at in enumerate(places[d]):
            nodes[at] = digest("".join(nodes[k] for k in below[i * ARITY : (i + 1) * ARITY]))
    return nodes


def sides(nodes: list[str | None], height: int, n: int) -> list[list[tuple[str, str]]]:
    """For each of a block's ``n`` leaves, level by level up to the block's root: its run's others to the left and to the right."""
    out: list[list[tuple[str, str]]] = [[] for _ in range(n)]
    for d in range(height, 0, -1):
        width = ARITY ** (height - d)
        row = [nodes[at] for at in address(height + 1, d, np.arange(-(-n // width)))]
        cut = [("".join(row[k - k % ARITY : k]), "".join(row[k + 1 : k - k % ARITY + ARITY])) for k in range(len(row))]
        for i in range(n):
            out[i].append(cut[i // width])
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def field(c: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with their rank ``k`` in the group, from 0, and the group's size ``n``; a large group lies in many ranges, each ranked alone."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stored(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), label)
    counts = placed.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range that a group reaches into.
    starts = counts.select(group, "__part", "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy(group)).alias("n"))
    return placed.join(starts, [group, "__part"]).withColumn("k", F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__at", "__first", "__before")


def height_of(n: Column) -> Column:
    """Levels of hashing over ``n`` leaves: 0 for a lone one."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**h) for h in range(15)]), lambda full: full < n))


def _blocks(rows: DataFrame, round_: int, levels: int) -> DataFrame:
    """(tree, block, height, own, digests, items, nodes, root): blocks of this round from rows of (tree, k, height, digest, item); ``height`` is the whole tree's, ``own`` the block's."""
    wide = ARITY**levels
    grouped = rows.groupBy("tree", F.expr(f"k div {wide}").alias("block"), "height").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "item"))).alias("leaves"))
    own = F.least(F.col("height") - F.lit(levels * round_), F.lit(levels))
    grouped = grouped.select("tree", "block", "height", own.alias("own"), F.col("leaves.digest").alias("digests"), F.col("leaves.item").alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [built(ds, h) for ds, h in zip(batch["digests"].to_pylist(), batch["own"].to_pylist(), strict=True)]
            batch = batch.append_column("nodes", pa.array(nodes, pa.list_(pa.string())))
            yield batch.append_column("root", pa.array([n[0] for n in nodes], pa.string()))

    made = grouped.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in grouped.schema)}, nodes array<string>, root string")
    return stored(made, f"merkle-round-{round_}")


def build(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The rounds of all trees, each a table of blocks of ``levels`` levels, from leaves of (tree, k, n, digest, item)."""
    rows = leaves.withColumn("height", height_of(F.col("n")))
    rounds = [_blocks(rows, 0, levels)]
    tallest = rounds[0].agg(F.max("height")).first()[0] or 0
    while levels * len(rounds) < tallest:
        done = len(rounds)
        below = rounds[-1].where(F.col("height") > levels * done)
        rounds.append(_blocks(below.select("tree", F.col("block").alias("k"), "height", F.col("root").alias("digest"), F.lit(None).cast("string").alias("item")), done, levels))
    return rounds


def roots(rounds: list[DataFrame], levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, root): the top of each tree."""
    tops = [r.where(F.col("height") <= levels * (i + 1)).select("tree", "root") for i, r in enumerate(rounds)]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _below(blocks: DataFrame, slot: str, levels: int) -> DataFrame:
    """For each leaf of ``blocks`` (with ``above``): (tree, ``slot``, item, above), where above now leads from the leaf to the top."""
    wide = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                above = [(x["left"], x["right"]) for x in r["above"]]
                paths = [[{"left": a, "right": b} for a, b in p + above] for p in sides(r["nodes"], r["own"], len(r["items"]))]
                first, n = r["block"] * wide, len(paths)
                kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(r["items"], pa.string()), pa.array(paths, kind)], names=["tree", slot, "item", "above"])

    return blocks.select("tree", "block", "own", "items", "nodes", "above").mapInArrow(run, f"tree string, {slot} bigint, item string, above {_SIDES}")


def with_above(rounds: list[DataFrame], tops: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The blocks of the first round with ``above``: the sides from the block's root to the top; tops: (tree, above) of the trees."""
    handed = None
    for i in range(len(rounds) - 1, -1, -1):
        last = F.col("height") <= levels * (i + 1)
        here = rounds[i].where(last).join(tops, "tree")
        if handed is not None:
            here = here.unionByName(rounds[i].where(~last).join(handed, ["tree", "block"]))
        handed = None if i == 0 else _below(here, "block", levels).drop("item")
    return here


PROVED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(leaves, rounds of the groups' trees, rounds of the tree over groups) of a table with the columns ``FIELDS``.

    leaves: tree (the group as text, null as empty and others after an ``s``), k,
    n, digest, item (id and the changed leaf, in the form that ``proofs`` reads).
    """
    columns = [F.col(c) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(struck, leaf_of(*columns[:-1], lowered))
    item = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), changed)  # a null one is left out
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf_of(*columns).alias("digest"), item.alias("item"))
    leaves = numbered(leaves, "tree", ["doc_id", "digest"], "merkle-leaves")
    rounds = build(leaves, levels)
    groups = roots(rounds, levels).select(F.lit(_WHOLE).alias("tree"), F.col("tree").alias("item"), F.col("root").alias("digest"))
    return leaves, rounds, build(numbered(groups, "tree", ["item"], "merkle-groups"), levels)


def proofs(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    proof_sha256 is the hash of all siblings on the way to the root; folded_root
    is recomputed from the changed leaf where the row was tampered with.
    """
    _, rounds, whole = manifest(docs, levels)
    spark = docs.sparkSession
    start = F.array().cast(_SIDES)
    tops = _below(with_above(whole, spark.range(1).select(F.lit(_WHOLE).alias("tree"), start.alias("above")), levels), "k", levels)
    blocks = with_above(rounds, tops.select(F.col("item").alias("tree"), "above"), levels)
    top = roots(whole, levels).first()  # one row, none of an empty table
    blocks = blocks.join(roots(rounds, levels).withColumnRenamed("root", "subroot"), "tree").withColumn("top", F.lit(top["root"] if top else None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                above, out = [(x["left"], x["right"]) for x in r["above"]], []
                over = "".join(a + b for a, b in above)
                places = address(r["own"] + 1, r["own"], np.arange(len(r["items"])))
                for item, at, path in zip(r["items"], places, sides(r["nodes"], r["own"], len(r["items"])), strict=True):
                    doc_id, _, changed = item.partition(":")
                    leaf = r["nodes"][at]
                    proof = digest("".join(a + b for a, b in path) + over)
                    out.append((None if doc_id == "-" else int(doc_id), leaf, r["subroot"], r["top"], proof, folded(changed or leaf, path + above)))
                kinds = [pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PROVED.split(", ")])

    made = blocks.select("own", "items", "nodes", "above", "subroot", "top").mapInArrow(run, PROVED)
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
