"""Near-duplicate documents by SetSketch registers.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Its sketch has M registers; each is the smallest of exponentially distributed
hashes of the set, kept as a truncated logarithm to a base just over 1.  The
registers of a union are the larger of both sketches' registers, and two
registers agree about as often as the sets overlap.

1. One pass over the texts gives set size, sketch and a 128-bit key of the word
   sequence.  Rows with equal keys are copies; from here on one class stands
   for them, so copies are never paired with each other.
2. Registers are banded.  In each bucket all members are compared with one of
   them, that which meets the most others in all its buckets: as many pairs as
   members, however large the bucket.
3. Each pair is estimated jointly from both sketches by maximum likelihood;
   what could reach the threshold is confirmed on the full sets.
4. Confirmed links are closed to components.  Where the members of a bucket are
   not in one component yet, its members from different components meet again
   in an exact prefix-filter join, which pairs what can still reach the
   threshold; estimates and full sets confirm those pairs, and the links are
   closed again.  Two texts that share a bucket thus stay apart only if no
   chain of links joins them.

With R registers a band and B bands, a pair of similarity J shares no bucket with
probability (1 - J^R)^B: 3e-6 at the default threshold of 0.8, 7e-9 at 0.85.

Defined results: null and empty texts, and texts of white space, have an empty
set and are linked with nothing; fewer than five words form one shingle; each
row is returned once, so repeated rows appear as often as given, in one
component; rows with a null id are returned with a null component, linked with
nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import stored

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Base of the registers' logarithm and their largest value.
BASE, TOP = 1.001, 65_535
#: Rate of the exponential hashes: keeps registers of sets of 1 to 10^12 elements inside their range.
RATE = 1 / 40
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Standard deviations that a joint estimate may fall short of the threshold.
SLACK = 5.0
#: Rows that one task of the first pass hashes together, in words.
BATCH_WORDS = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors: each permutes the 64-bit numbers in another way.
_FACTORS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, size=REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def sequence_key(ws: list[bytes]) -> bytes | None:
    """A 128-bit key of the word sequence; None without words."""
    return hashlib.md5(b" ".join(ws), usedforsecurity=False).digest() if ws else None


def word_codes(texts: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of all words in a row."""
    flat = np.empty(sum(map(len, texts)), dtype=object)
    flat[:] = [w for ws in texts for w in ws]
    if not len(flat):
        return np.zeros(0, dtype=np.uint64)
    codes, distinct = pd.factorize(flat)
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))[codes]


def shingle_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, out, at = word_codes(texts), [], 0
    with np.errstate(over="ignore"):
        n = len(codes) - SHINGLE_WORDS + 1
        rolled = np.full(max(n, 0), SHINGLE_WORDS, dtype=np.uint64)
        for j in range(SHINGLE_WORDS if n > 0 else 0):
            rolled = mixed(rolled * _MIX + codes[j : j + n])
        for ws in texts:
            if len(ws) >= SHINGLE_WORDS:
                out.append(np.unique(rolled[at : at + len(ws) - SHINGLE_WORDS + 1]))
            elif ws:
                x = np.full(1, len(ws), dtype=np.uint64)
                for c in codes[at : at + len(ws)]:
                    x = mixed(x * _MIX + c)
                out.append(x)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += len(ws)
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set, as unsigned 16-bit numbers."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            least = np.minimum(least, (shingles[i : i + 1024, None] * _FACTORS).min(axis=0))
    # The smallest uniform hash gives the smallest exponential one.
    smallest = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
    return np.clip(np.floor(1 - np.log(RATE * smallest) / math.log(BASE)), 0, TOP).astype("<u2")


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates for pairs of sketches (one pair a row) of sets with known sizes.

    With u = n_a / (n_a + n_b) and v = n_b / (n_a + n_b), a register of a is the
    larger with probability p(u - v J) and the smaller with p(v - u J), where
    p(x) = -log_BASE(1 - x (BASE - 1) / BASE).  The likelihood of the observed
    counts has one maximum in J, found by golden-section search.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1.0 - u

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / math.log(BASE)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1.0))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        c, d = high - g * (high - low), low + g * (high - low)
        right = value(c) < value(d)
        low, high = np.where(right, c, low), np.where(right, high, d)
    return (low + high) / 2


def lowest_estimate(percent: int = PERCENT) -> float:
    j = percent / 100
    return j - SLACK * math.sqrt(j * (1 - j) / REGISTERS)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, n_shingles, key, registers) of every row; key and registers are null for an empty set, digest names the text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in word_batches(batch.column(2)):
                sets = shingle_sets(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(rows)),
                        batch.column(1).slice(start, len(rows)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(map(sequence_key, rows), pa.binary()),
                        pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "digest", "n_shingles", "key", "registers"],
                )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), digest_of(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, digest binary, n_shingles bigint, key binary, registers binary")


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def word_batches(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of rows of about BATCH_WORDS words: first row, and the words of each."""
    start, rows, size = 0, [], 0
    for i, t in enumerate(texts):
        rows.append(normal_words(t.as_py()))
        size += len(rows[-1])
        if size >= BATCH_WORDS:
            yield start, rows
            start, rows, size = i + 1, [], 0
    if rows:
        yield start, rows


def full_sets(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in word_batches(batch.column(0)):
                sets = [s.view(np.int64) for s in shingle_sets(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(map(sequence_key, rows), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key binary, shingles array<bigint>")


def _band_rows(classes: DataFrame) -> DataFrame:
    """(bucket, key, n) for every band of every class; a bucket is a band's number and its registers."""
    width = 2 * ROWS
    bands = F.array(*[F.concat(F.lit(bytes([i])), F.substring(F.col("registers"), 1 + i * width, width)) for i in range(BANDS)])
    return classes.select(F.explode(bands).alias("bucket"), "key", "n")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose joint estimate comes near the threshold."""
    side = lambda c: classes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    sketched = pairs.join(side("a"), "a").join(side("b"), "b")
    floor = lowest_estimate(percent)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
            yield batch.select(["a", "b"]).filter(pa.array(jaccard_estimate(*regs, *sizes) >= floor))

    return stored(sketched.mapInArrow(likely, "a binary, b binary"), "near-likely")


def _sets_of(keys: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, shingles) of the given keys, from the texts of one document of each."""
    ids = stored(classes.join(keys, "key", "left_semi").select(F.col("id").alias("__near_id")), "near-wanted")
    texts = docs.join(ids, docs[id_col] == F.col("__near_id"), "left_semi")
    return stored(full_sets(texts, text_col).dropDuplicates(["key"]), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").withColumn("shared", F.size(F.array_intersect("s_a", "s_b")))
    either = F.size("s_a") + F.size("s_b") - F.col("shared")
    return stored(both.where(100 * F.col("shared") >= percent * either).select("a", "b"), "near-links")


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of ``members`` (key, n, root) with different roots that may reach the threshold.

    Exact prefix filtering.  Shingles are ordered from rare to frequent.  Two
    sets that reach the threshold share a shingle among the first of either,
    and what is left behind their first common shingle must be enough.  Members
    of a large family share their frequent shingles, but those of a text that
    was edited much stand too far back to pair it.
    """
    each = stored(sets.join(members, "key").select("key", "n", "root", F.explode("shingles").alias("s")), "near-shingles")
    rare = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    listed = each.join(rare, "s").groupBy("key", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("xs"))
    probe = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    front = listed.select("key", "n", "root", F.posexplode(F.slice("xs", F.lit(1), probe.cast("int"))).alias("i", "x"))
    front = stored(front.where("x.df > 1").select("key", "n", "root", "i", F.col("x.s").alias("s")), "near-prefixes")
    index = F.col("n") - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}") + 1
    x = front.where(F.col("i") < index).select("s", *[F.col(c).alias(f"{c}_x") for c in ("key", "n", "root", "i")])
    larger = (F.col("n_x") < F.col("n")) | ((F.col("n_x") == F.col("n")) & (F.col("key_x") < F.col("key")))
    enough = F.least(F.col("n_x") - F.col("i_x"), F.col("n") - F.col("i")) * (100 + percent) >= percent * (F.col("n_x") + F.col("n"))
    met = (x["s"] == front["s"]) & (F.col("root_x") != F.col("root")) & larger & enough
    return x.join(front, met).select(F.least("key_x", "key").alias("a"), F.greatest("key_x", "key").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in ``links`` (a, b): root is the smallest key it can reach.

    Each round gives every key the smallest root among its own and its
    neighbours', then follows that root to its own.  Rounds grow with the
    logarithm of the longest chain, and each is written before the next.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-edges")
    roots = stored(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("root")), "near-roots")
    while True:
        seen = edges.join(roots.select(F.col("key").alias("b"), "root"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        pulled = roots.join(seen, "key").select("key", "root", F.least("root", "near").alias("new"))
        jump = roots.select(F.col("key").alias("new"), F.col("root").alias("beyond"))
        best = F.least("new", "beyond")
        nxt = stored(pulled.join(jump, "new").select("key", best.alias("root"), (best != F.col("root")).alias("moved")), "near-roots")
        roots = nxt.select("key", "root")
        if nxt.where("moved").isEmpty():
            return roots


def _with_components(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, n_shingles, component_id (null where the set is empty or the id is null)."""
    rows = stored(sketches(docs, id_col, text_col), "near-sketches")
    known = rows.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = stored(classes, "near-classes")
    banded = _band_rows(classes)
    sizes = stored(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    members = stored(banded.join(sizes, "bucket"), "near-members")
    # The member that meets the most others over all its buckets stands nearest to the middle of a family: it leads its buckets.
    met = members.groupBy("key").agg(F.sum("size").alias("met"))
    led = stored(members.join(met, "key").groupBy("bucket").agg(F.max(F.struct("met", "key", "n")).alias("head")), "near-heads")
    apart = (F.col("key") != F.col("head.key")) & (100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n"))
    first = members.join(led, "bucket").where(apart).select(F.col("head.key").alias("a"), F.col("key").alias("b"))
    hopeful = _likely(stored(first.distinct(), "near-pairs"), classes, percent)
    wanted = hopeful.select(F.col("a").alias("key")).union(hopeful.select("b")).distinct()
    links = _confirmed(hopeful, _sets_of(wanted, classes, docs, id_col, text_col), percent)
    roots = components(links)
    # Buckets that still hold several components.
    rooted = members.select("bucket", "key", "n").join(roots, "key", "left").select("bucket", "key", "n", F.coalesce("root", "key").alias("root"))
    rooted = stored(rooted, "near-rooted")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    unsettled = stored(rooted.join(stored(several, "near-several"), "bucket", "left_semi").select("key", "n", "root").distinct(), "near-unsettled")
    if not unsettled.isEmpty():
        sets = _sets_of(unsettled.select("key"), classes, docs, id_col, text_col)
        second = _likely(stored(_across(unsettled, sets, percent), "near-pairs"), classes, percent)
        more = _confirmed(second, sets, percent)
        if not more.isEmpty():
            roots = components(links.union(more))
    of_key = classes.select("key", "id").join(roots, "key", "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    smallest = of_key.groupBy("root").agg(F.min("id").alias("component"))
    of_key = stored(of_key.join(smallest, "root").select("key", "component"), "near-components")
    return rows.join(of_key, "key", "left").select("doc_id", "digest", "n_shingles", F.col("component").alias("component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    component = F.coalesce("component_id", "doc_id")
    out = _with_components(docs, id_col, text_col, percent)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with all columns, one row of each component left.

    The smallest id stays, of several texts with that id the one with the
    smallest digest, and of rows equal in both one.  Rows with an empty set or a
    null id are in no component and all stay.
    """
    gone, again = "__near_gone", "__near_again"
    linked = stored(_with_components(docs, id_col, text_col, percent).where(F.col("component_id").isNotNull()).select("component_id", "doc_id", "digest"), "near-linked")
    one = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest")).alias("one"))
    # Rows that resemble nothing are their component's only one and need no join of the texts.
    several = linked.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("component_id")).join(one, "component_id")
    is_one = (F.col("doc_id") == F.col("one.doc_id")) & (F.col("digest") == F.col("one.digest"))
    marked = stored(several.where(~is_one | (F.col("n") > 1)).select(F.col("doc_id").alias(gone), F.col("digest").alias(again), is_one.alias("is_one")), "near-marked")
    named = (docs[id_col] == F.col(gone)) & (digest_of(docs[text_col].cast("string")) == F.col(again))
    rest = docs.join(marked, named, "left_anti")
    repeated = marked.where("is_one")
    if repeated.isEmpty():
        return rest
    return rest.unionByName(docs.join(repeated, named, "left_semi").dropDuplicates([id_col, text_col]))
