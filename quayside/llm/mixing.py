"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent and normalised,
w = p**a / sum(p**a).  The exponent is bisected on [0, 1]: a = 1 keeps the
natural mix, a = 0 makes it uniform.  The largest exponent is taken at which the
mix still has the target entropy, ``evenness`` times that of a uniform mix,
unless a source would then be passed over more than ``max_repeats`` times; the
exponent then grows until none is.

The weights are then realised.  Each source owes ``budget * w`` tokens.  Its
documents are dealt into blocks by a seeded hash, blocks follow one another in
order of the block number and documents in a block in order of their hash,
which is a permutation of the source.  Whole passes over it come first, the
rest ends the last pass: a document is taken when its first token lies inside
the rest.  Running sums are taken over block groups, blocks and documents in
turn, so no window holds more than one block, however large the source.

Defined results: a null source is a source of its own; a null or empty text has
no tokens and is never taken in the partial pass; every row counts, also
repeated ones and those with a null id.  The hash is of the id and the text;
rows that tie there are taken together, unless so many do (``TIES``) that they
would fill a block: their places in the input then tell them apart.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import stored

#: Tokens and rows that a block holds on average, at most, and blocks in a block group.
BLOCK_TOKENS, BLOCK_ROWS, GROUP_BLOCKS = 1 << 15, 1 << 12, 1 << 10
#: Rows with one hash from which on they are told apart.
TIES = 256
#: Halvings of the exponent's interval.
STEPS = 50
MAX_REPEATS = 4.0
#: Target entropy, as a share of the largest that as many sources can have.
EVENNESS = 0.95

_NULL_SOURCE = "\x00null"


def count_tokens(text: Column) -> Column:
    """Words, as runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _powers(shares: Column, a: Column) -> Column:
    return F.transform(shares, lambda p: F.when(p > 0, F.pow(p, a)).otherwise(F.lit(0.0)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _entropy(shares: Column, a: Column) -> Column:
    """log T - sum(x log x) / T of the raised shares x with total T, in one pass over the sources."""
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("xlogx"))

    def add(s: Column, p: Column) -> Column:
        x = F.when(p > 0, F.pow(p, a)).otherwise(F.lit(0.0))
        return F.struct((s["t"] + x).alias("t"), (s["xlogx"] + F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))).alias("xlogx"))

    return F.aggregate(shares, start, add, lambda s: F.when(s["t"] > 0, F.log(s["t"]) - s["xlogx"] / s["t"]).otherwise(F.lit(0.0)))


def _repeats(shares: Column, a: Column, budget_share: float | None) -> Column:
    """How often the most repeated source is passed over, for a budget of ``budget_share`` times all tokens."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("t"), none.alias("low"), none.alias("high"))

    def add(s: Column, p: Column) -> Column:
        x = F.when(p > 0, F.pow(p, a)).otherwise(F.lit(0.0))
        ratio = F.when(p > 0, x / p)
        return F.struct((s["t"] + x).alias("t"), F.least(s["low"], ratio).alias("low"), F.greatest(s["high"], ratio).alias("high"))

    if budget_share is None:  # the least passed source is passed once
        return F.aggregate(shares, start, add, lambda s: s["high"] / s["low"])
    return F.aggregate(shares, start, add, lambda s: F.lit(budget_share) * s["high"] / s["t"])


def _bisect(shares: Column, value, target: Column) -> Column:
    """The least exponent in [0, 1] at which ``value``, which falls as the exponent grows, is not above ``target``."""

    def step(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        over = value(shares, mid) > target
        return F.struct(F.when(over, mid).otherwise(state["lo"]).alias("lo"), F.when(over, state["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["hi"])


def source_weights(totals: DataFrame, *, budget_share: float | None = 1.0, max_repeats: float = MAX_REPEATS, evenness: float = EVENNESS) -> DataFrame:
    """(src, n_tokens) of every source to (src, n_tokens, exponent, weight, owed).

    One row per source meets in one array here: this is bounded by the number
    of sources, not by their documents.
    """
    listed = totals.agg(F.sort_array(F.collect_list(F.struct("src", "n_tokens"))).alias("all"))
    whole = F.aggregate(F.col("all"), F.lit(0).cast("long"), lambda s, x: s + x["n_tokens"])
    shares = listed.withColumn("whole", whole).withColumn("shares", F.transform("all", lambda x: F.when(F.col("whole") > 0, x["n_tokens"] / F.col("whole")).otherwise(F.lit(0.0))))
    present = F.size(F.filter("shares", lambda p: p > 0))
    shares = shares.withColumn("aim", F.lit(evenness) * F.log(F.greatest(present, F.lit(1)).cast("double")))
    by_entropy = _bisect(F.col("shares"), _entropy, F.col("aim"))
    by_repeats = _bisect(F.col("shares"), lambda s, x: _repeats(s, x, budget_share), F.lit(float(max_repeats)))
    found = shares.withColumn("exponent", F.greatest(by_entropy, by_repeats)).withColumn("raised", _powers(F.col("shares"), F.col("exponent"))).withColumn("norm", _total(F.col("raised")))
    rows = found.select("whole", "exponent", "norm", F.explode(F.arrays_zip("all", "raised", "shares")).alias("x"))
    weight = F.when(F.col("norm") > 0, F.col("x.raised") / F.col("norm")).otherwise(F.lit(0.0))
    rows = rows.select(F.col("x.all.src").alias("src"), F.col("x.all.n_tokens").alias("n_tokens"), "exponent", weight.alias("weight"), "whole", F.col("x.shares").alias("share"))
    if budget_share is None:
        least = rows.where(F.col("share") > 0).agg(F.min(F.col("weight") / F.col("share")).alias("least"))
        rows = rows.join(F.broadcast(least)).withColumn("budget", F.col("whole") / F.col("least"))  # one row
    else:
        rows = rows.withColumn("budget", F.col("whole") * F.lit(float(budget_share)))
    owed = F.round(F.coalesce(F.col("weight") * F.col("budget"), F.lit(0.0)))
    return rows.select("src", "n_tokens", "exponent", "weight", owed.cast("long").alias("owed"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget_share: float | None = 1.0,
    max_repeats: float = MAX_REPEATS,
    evenness: float = EVENNESS,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, block, copies, weight, exponent.

    ``copies`` is how often the mixed corpus holds the document: the whole
    passes over its source, and one more if the partial pass takes it.  The
    budget is ``budget_share`` times all tokens; with None it is the least at
    which every source is passed once, so that no document is left out.
    """
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL_SOURCE))
    light = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            src.alias("src"),
            count_tokens(F.col(text_col).cast("string")).alias("n_tokens"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-tokens",
    )
    # Only hashes that very many rows share: their number is that of rows over TIES at most, and Spark picks the join by its size.
    tied = light.groupBy("src", "h").agg(F.count(F.lit(1)).alias("ties")).where(F.col("ties") >= TIES).select("src", "h", F.lit(True).alias("tied"))
    totals = light.groupBy("src").agg(F.sum("n_tokens").alias("n_tokens"))
    weights = stored(source_weights(totals, budget_share=budget_share, max_repeats=max_repeats, evenness=evenness), "mix-weights")
    plan = weights.join(light.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows")), "src").select(
        "src",
        F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / BLOCK_TOKENS), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("long").alias("n_blocks"),
        F.when(F.col("n_tokens") > 0, F.expr("owed div n_tokens")).otherwise(F.lit(0)).cast("long").alias("passes"),
        F.when(F.col("n_tokens") > 0, F.col("owed") % F.col("n_tokens")).otherwise(F.lit(0)).cast("long").alias("rest"),
        "weight",
        "exponent",
    )
    plan = stored(plan, "mix-plan")  # a row for each source: read from a file, its size is known
    told = light.join(stored(tied, "mix-ties"), ["src", "h"], "left").withColumn("h", F.when(F.col("tied"), F.xxhash64("h", "row")).otherwise(F.col("h"))).drop("tied", "row")
    dealt = told.join(plan, "src").withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("n_blocks"))).withColumn("grp", F.expr(f"block div {GROUP_BLOCKS}"))

    def before(*part: str) -> Window:
        return Window.partitionBy(*part)

    # Running sums from the top down: groups of a source, blocks of a group, documents of a block.
    blocks = dealt.groupBy("src", "grp", "block").agg(F.sum("n_tokens").alias("t"))
    groups = blocks.groupBy("src", "grp").agg(F.sum("t").alias("t"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("src", "grp", F.coalesce(F.sum("t").over(up_to(before("src").orderBy("grp"))), F.lit(0)).alias("g0"))
    blocks = blocks.select("src", "grp", "block", F.coalesce(F.sum("t").over(up_to(before("src", "grp").orderBy("block"))), F.lit(0)).alias("b0"))
    starts = blocks.join(groups, ["src", "grp"]).select("src", "block", (F.col("g0") + F.col("b0")).alias("b0"))
    same = before("src", "block", "h")
    placed = dealt.withColumn("through", F.sum("n_tokens").over(before("src", "block").orderBy("h"))).withColumn("own", F.sum("n_tokens").over(same))
    placed = placed.join(starts, ["src", "block"]).withColumn("first", F.col("b0") + F.col("through") - F.col("own"))
    taken = ((F.col("n_tokens") > 0) & (F.col("first") < F.col("rest"))).cast("long")
    return placed.select("doc_id", "source", "n_tokens", "block", (F.col("passes") + taken).alias("copies"), "weight", "exponent")
