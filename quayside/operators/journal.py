"""Receipts, the journal of events and what leaves it: integrity, appends, typed events, refreshes, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import scalars
from quayside.operators.sequences import running_last, running_rank

#: Licenses that may be kept, and those that may be exported inside and to others.
RETAINED = ("open", "licensed", "internal")
EXPORTED = {"research": ("open", "licensed", "internal"), "redistribution": ("open",)}
#: Time qualities: observed and delayed ones become effective when received.
OBSERVED, DELAYED, VERIFIED, ESTIMATED = 1, 2, 3, 4


def first_problem(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for broken, name in rules])


def receipt_problems(stored: DataFrame, commits: DataFrame) -> DataFrame:
    """(receipt_id, problem) of stored receipts: receipt_id, license, started_ns, received_ns, payload, crc, digest; commits: receipt_id."""
    nth = F.row_number().over(Window.partitionBy("receipt_id").orderBy("received_ns", "digest"))
    done = commits.select(F.col("receipt_id").alias("__done")).distinct()
    seen = stored.withColumn("__nth", nth).join(done, F.col("receipt_id") == F.col("__done"), "left")
    problem = first_problem(
        (F.col("__done").isNull(), "not committed"),
        (F.crc32(F.col("payload").cast("binary")) != F.col("crc"), "checksum"),
        (F.sha2("payload", 256) != F.col("digest"), "digest"),
        (F.col("__nth") > 1, "duplicate id"),
        (~F.col("license").isin(*RETAINED), "license"),
        (F.col("received_ns") < F.col("started_ns"), "time order"),
    )
    return seen.select("receipt_id", problem.alias("problem"))


def appended_batches(journal: DataFrame, batches: DataFrame, *, key: list[str], cell: str, base: int) -> DataFrame:
    """(batch, ordinal, accepted, sequence): batches (batch, ordinal, event_id, key) against the journal's keys.

    A batch with an event without id, a key twice, or a key that the journal has
    goes whole; the events of the others get the numbers after ``base`` without
    gaps, in order of batch and ordinal.  cell: never falls along the batch.
    """
    again = F.row_number().over(Window.partitionBy("batch", *key).orderBy("ordinal")) > 1
    marked = batches.withColumn("__again", again).join(journal.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct().withColumn("__known", F.lit(True)), [F.col(k) == F.col(f"__{k}") for k in key], "left")
    wrong = F.col("__again") | F.coalesce("__known", F.lit(False)) | (F.coalesce("event_id", F.lit(0)) == 0)
    judged = marked.groupBy("batch").agg(F.bool_or(wrong).alias("wrong")).select("batch", (~F.col("wrong")).alias("accepted"))
    rows = batches.select("batch", "ordinal", cell).join(judged, "batch")
    numbered = running_rank(rows.where("accepted"), cell=cell, order=["batch", "ordinal"], into="n").select("batch", "ordinal", (F.col("n") + base).alias("sequence"))
    return rows.join(numbered, ["batch", "ordinal"], "left").select("batch", "ordinal", "accepted", "sequence")


def batch_integrity(events: DataFrame, *, cell: int = 1000) -> DataFrame:
    """(batch, first_seq, last_seq, n, dense, joined, repeated): events: batch, sequence, key.

    dense: the batch's numbers have no gap; joined: its first follows the last of
    the batch before; repeated: events whose key came before in the batch.
    """
    sizes = events.groupBy("batch").agg(F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))
    sizes = sizes.withColumn("__cell", F.floor(F.col("batch") / cell)).withColumn("__one", F.lit(1))
    linked = running_last(sizes, on=["__one"], cell="__cell", order=["batch"], value=F.col("last_seq"), into="before")
    return linked.select("batch", "first_seq", "last_seq", "n", (F.col("last_seq") - F.col("first_seq") + 1 == F.col("n")).alias("dense"), (F.col("first_seq") == F.coalesce("before", F.lit(0)) + 1).alias("joined"), (F.col("n") - F.col("keys")).alias("repeated"))


def replay_reports(events: DataFrame, cutoff: Column) -> DataFrame:
    """(batch, n, runs, first_seq, last_seq, digest): what a replay up to ``cutoff`` gives of each batch.

    events: batch, sequence, effective_ns, value.  A run is a stretch of events
    without a gap; the digest is of all events of the batch in order, so a batch,
    which has a greatest size, meets in one task.
    """
    fit = events.where(cutoff.isNull() | (F.col("effective_ns") <= cutoff))
    run = F.col("sequence") - F.row_number().over(Window.partitionBy("batch").orderBy("sequence"))
    line = F.concat_ws(":", "sequence", "effective_ns", "value")
    out = fit.withColumn("run", run).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs"), F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"),
        F.sort_array(F.collect_list(F.struct("sequence", line.alias("line")))).alias("all"),
    )
    return out.select("batch", "n", "runs", "first_seq", "last_seq", F.sha2(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), 256).alias("digest"))


def effective_ns(kind: Column, quality: Column, event: Column, received: Column) -> Column:
    """When an event becomes known: quotes and live values when received, delayed ones too for prices, all others at their own time."""
    live = (quality == OBSERVED) | ((quality == DELAYED) & kind.isin("index", "bar"))
    return F.when((kind == "quote") | live, received).otherwise(event)


def typed_problem() -> Column:
    """What is wrong with an event of its kind: kind, source_event_id, a to f (its values), quality.

    index: price; quote: bid, ask; bar: open, high, low, close, open time, minutes
    with its close as event_ns; observation: start, end, value, vintage;
    positioning: participant, long, short, spread, open interest; release:
    scheduled.
    """
    is_ = lambda k: F.col("kind") == k
    value = lambda c: F.col(c)
    return first_problem(
        (~F.coalesce(F.col("kind").isin("index", "quote", "bar", "observation", "positioning", "release"), F.lit(False)), "kind"),
        (is_("quote") & (value("a") > value("b")), "crossed quote"),
        (is_("bar") & ((value("e") < 0) | (F.col("event_ns") <= value("e"))), "bar window"),
        (is_("bar") & (F.coalesce(value("f"), F.lit(0)) == 0), "bar timeframe"),
        (is_("bar") & ((value("c") > value("b")) | (value("b") < F.greatest(value("a"), value("d"))) | (value("c") > F.least(value("a"), value("d")))), "bar prices"),
        (is_("observation") & value("c").isNull(), "no value"),
        (is_("observation") & ((value("a") >= value("b")) | (F.coalesce(value("d"), F.lit(0)) == 0)), "observation identity"),
        (is_("positioning") & ((value("b") < 0) | (value("c") < 0) | (value("d") < 0) | (value("e") <= 0)), "positioning counts"),
        ((F.col("effective_ns") < F.col("received_ns")) & F.col("quality").isin(OBSERVED, DELAYED), "known before received"),
        (F.coalesce("source_event_id", F.lit(0)) == 0, "no event id"),
    )


def availability(mode: Column, flags: Column) -> Column:
    """replaying in a replay; else live, delayed or stale by the time quality of the flags."""
    q = scalars.time_quality(flags)
    return F.when(mode == "replay", "replaying").when(q == OBSERVED, "live").when(q == DELAYED, "delayed").otherwise("stale")


def has_value(state: Column) -> Column:
    return state.isin("ready", "live", "delayed", "stale", "replaying")


def complete_refreshes(receipts: DataFrame, expected: DataFrame) -> DataFrame:
    """(refresh_id, complete, problem): receipts: refresh_id, code, status; expected: code.  Every code once, all with status 200."""
    known = expected.select(F.col("code").alias("__code")).distinct()
    wanted = known.agg(F.count(F.lit(1)).alias("wanted"))  # one row
    seen = receipts.join(known, F.col("code") == F.col("__code"), "left")
    each = seen.groupBy("refresh_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__code").alias("codes"), F.bool_or(F.col("__code").isNull()).alias("strange"), F.bool_and(F.col("status") == 200).alias("fine"))
    out = each.join(F.broadcast(wanted))
    problem = first_problem((~F.col("fine"), "status"), (F.col("strange"), "unknown code"), (F.col("n") > F.col("codes"), "duplicate code"), (F.col("codes") < F.col("wanted"), "missing code"))
    return out.select("refresh_id", problem.isNull().alias("complete"), problem.alias("problem"))


def bound_titles(rows: DataFrame, prefixes: DataFrame, *, title: str) -> DataFrame:
    """``rows`` with the ``code`` of the longest prefix that begins their title; null if none does.

    prefixes: prefix, code.  Titles are cut to each length that prefixes have, so
    the join is one on equal texts.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect()]  # as many as prefixes have lengths
    cut = rows.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring(title, 1, n).alias("start")) for n in lengths])).alias("__cut"))
    met = cut.join(prefixes.select(F.col("prefix").alias("__prefix"), "code"), F.col("__cut.start") == F.col("__prefix"), "left")
    best = met.groupBy(*rows.columns).agg(F.max(F.when(F.col("code").isNotNull(), F.struct(F.col("__cut.n").alias("n"), "code"))).alias("best"))
    return best.select(*rows.columns, F.col("best.code").alias("code"))


def material_batches(events: DataFrame) -> DataFrame:
    """(batch, family, first_seq, last_seq, received_ns, n, corrections) of the batches that have one source and rising numbers.

    events: batch, ordinal, kind, source, sequence, received_ns, corrected.
    """
    family = F.when(F.col("kind") == "observation", "observations").when(F.col("kind") == "positioning", "positioning").when(F.col("kind").isin("release", "document"), "provenance")
    before = F.lag("sequence").over(Window.partitionBy("batch", "family").orderBy("ordinal"))
    rows = events.withColumn("family", family).withColumn("falls", F.coalesce(F.col("sequence") <= before, F.lit(False)))
    sound = rows.groupBy("batch").agg((F.min("source") == F.max("source")).alias("one"), F.bool_or(F.col("family").isNull()).alias("strange"), F.bool_or("falls").alias("falls"), F.min("sequence").alias("least"))
    fine = sound.where("one and not strange and not falls and least > 0").select("batch")
    kept = rows.join(fine, "batch", "left_semi")
    return kept.groupBy("batch", "family").agg(F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"), F.max("received_ns").alias("received_ns"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("corrected"), 1)).alias("corrections"))


def manifest(segments: DataFrame, scope: str) -> DataFrame:
    """(dataset, sources, start_ns, end_ns, problem): segments: dataset, source, license, start_ns, end_ns."""
    each = segments.groupBy("dataset").agg(F.count_distinct("source").alias("sources"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.bool_and(F.col("license").isin(*EXPORTED[scope])).alias("allowed"), F.bool_or(F.col("start_ns") > F.col("end_ns")).alias("turned"))
    return each.select("dataset", "sources", "start_ns", "end_ns", first_problem((~F.col("allowed"), "license"), (F.col("turned"), "time range")).alias("problem"))


def write_manifest(entries: DataFrame, path: str) -> None:
    """Write the datasets without a problem as JSON; nothing is written if one has."""
    if not entries.where(F.col("problem").isNotNull()).isEmpty():
        raise ValueError("a dataset may not be exported")
    entries.drop("problem").write.json(path)


def slots(bars: DataFrame, width_ns: int) -> DataFrame:
    """(inst, s_open, slot, open_ns, there): every slot of a session from its open to its last bar; a slot without a bar is a gap."""
    ends = bars.groupBy("inst", "s_open").agg(F.max("open_ns").alias("last_ns"))
    grid = ends.select("inst", "s_open", F.posexplode(F.sequence(F.col("s_open"), F.col("last_ns"), F.lit(width_ns))).alias("slot", "open_ns"))
    held = bars.select("inst", "open_ns", F.lit(True).alias("there")).distinct()
    return grid.join(held, ["inst", "open_ns"], "left").select("inst", "s_open", F.col("slot").cast("long").alias("slot"), "open_ns", F.coalesce("there", F.lit(False)).alias("there"))


def orphan_positions(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """(epoch, accepted): an epoch's positions count only if the order that opened each is known.  positions: epoch, opened_by; orders: epoch, order_id."""
    known = orders.select(F.col("epoch").alias("__epoch"), F.col("order_id").alias("__order")).distinct()
    met = positions.join(known, (F.col("epoch") == F.col("__epoch")) & (F.col("opened_by") == F.col("__order")), "left")
    return met.groupBy("epoch").agg(F.bool_and(F.col("__order").isNotNull()).alias("accepted"), F.count(F.lit(1)).alias("n"))


def epoch_transactions(entries: DataFrame, *, on: list[str], cell: str) -> DataFrame:
    """(on, epoch, committed, shown): an epoch is taken if all its ledger entries can be appended; else the last one taken stays shown.

    entries: on, epoch, problem.  cell: a column that never falls along the epoch.
    """
    each = entries.groupBy(*on, "epoch", cell).agg(F.bool_and(F.col("problem").isNull()).alias("committed"))
    mine = F.when(F.col("committed"), F.col("epoch"))
    before = running_last(each, on=on, cell=cell, order=["epoch"], value=mine, into="before")
    return before.select(*on, "epoch", "committed", F.coalesce(mine, F.col("before")).alias("shown"))


def counted(entries: DataFrame) -> DataFrame:
    """One row: machine, operator and incident entries, the last record and the last canonical number: kind, status, recorded_ns, last_sequence."""
    from quayside.operators.ledger import OPERATOR_KINDS

    operator = F.col("kind").isin(*OPERATOR_KINDS)
    count = lambda c: F.count(F.when(c, F.lit(1)))
    return entries.agg(count(~operator).alias("machine"), count(operator).alias("operator"), count((F.col("kind") == "incident") | (F.col("status") == "incident")).alias("incidents"), F.max("recorded_ns").alias("published_ns"), F.max(F.coalesce("last_sequence", F.lit(0))).alias("last_sequence"))


def page_counts(entries: DataFrame) -> DataFrame:
    """One row of the ledger page over the visible entries: decisions, routed, blocked, fills, unknown."""
    from quayside.operators.ledger import CASE_KINDS, visible

    count = lambda c: F.count(F.when(c, F.lit(1)))
    kind = F.col("kind")
    return visible(entries).agg(
        count(kind == "decision").alias("decisions"), count(kind == "order").alias("routed"), count(F.col("status") == "rejected").alias("blocked"), count(kind == "fill").alias("fills"), count(kind.isin(*CASE_KINDS) & (F.col("case_id") == 0)).alias("unknown_n")
    )


#: The ordered digest: primes just under 2**31 and, for each, the base of its polynomial.
MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_812_433_253), (2_147_483_587, 1_664_525), (2_147_483_579, 69_069))
#: Digits of an exponent, in base ``_RADIX``, whose powers are looked up.
_RADIX, _DIGITS = 1024, 5


def _power(base: int, exponent: Column, prime: int) -> Column:
    """``base ** exponent % prime``: a product of one looked-up power for each digit of the exponent."""
    out = F.lit(1).cast("long")
    for d in range(_DIGITS):
        step = pow(base, _RADIX**d, prime)
        powers = [1]
        for _ in range(_RADIX - 1):
            powers.append(powers[-1] * step % prime)
        digit = F.shiftrightunsigned(exponent, 10 * d).bitwiseAND(_RADIX - 1).cast("int")
        out = out * F.get(F.array(*map(F.lit, powers)), digit) % prime if d else F.get(F.array(*map(F.lit, powers)), digit).cast("long")
    return out


def ordered_digest(rows: DataFrame, *, on: list[str], cell: str, order: str, line: Column) -> DataFrame:
    """(on, n, digest): a digest of each key's lines in order, which no task needs to see together.

    The digest is the fold ``h = (h * base + x) % prime`` over the lines, x being a
    32-bit part of a line's hash, for four primes.  A line with r lines after it
    adds ``x * base ** r``, so lines are summed in any order, where they lie, and
    two stretches join as ``h1 * base ** n2 + h2``.  cell: never falls along
    ``order``; ranks are counted in cells.
    """
    marked = rows.select(*on, cell, order, F.md5(line).alias("__hash"))
    ranked = running_rank(marked, on=tuple(on), cell=cell, order=[order], into="__rank")
    sizes = marked.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    met = ranked.join(sizes, on)
    after = F.col("n") - F.col("__rank")
    parts = []
    for i, (prime, base) in enumerate(MODULI):
        x = F.conv(F.substring("__hash", 8 * i + 1, 8), 16, 10).cast("long") % prime
        parts.append(F.sum((x * _power(base, after, prime) % prime).cast("decimal(20,0)")).alias(f"p{i}"))
    summed = met.groupBy(*on, "n").agg(*parts)
    text = F.concat(*[F.lpad(F.lower(F.hex((F.col(f"p{i}") % prime).cast("long"))), 8, "0") for i, (prime, _) in enumerate(MODULI)])
    return summed.select(*on, "n", text.alias("digest"))


def joined_digest(first: str, second: str, n_second: int) -> str:
    """The digest of two stretches, one after the other."""
    out = ""
    for i, (prime, base) in enumerate(MODULI):
        a, b = (int(d[8 * i : 8 * i + 8], 16) for d in (first, second))
        out += f"{(a * pow(base, n_second, prime) + b) % prime:08x}"
    return out
