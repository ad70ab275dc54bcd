"""Queries of receipts, the journal, typed events and scalar functions; their SQL is written apart from the operators, from the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import scalars
from quayside.operators import joins, journal, levels, nodes, structure
from quayside.operators.venue_ledger import order_states
from quayside.plans.views import view
from quayside.sources import decoders, venue
from quayside.sources.shared import written

DAY = 86_400_000_000_000


def receipt_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents, some spoilt by their number: payload or digest changed after they were written, an id used twice, no commit."""
    docs = view(spark, sf_dir, "select doc_id, text, case doc_id % 4 when 0 then 'open' when 1 then 'licensed' when 2 then 'internal' else case when doc_id % 8 = 3 then 'personal' else 'open' end end as license from @table(documents)")
    i = F.col("doc_id")
    stored = docs.select(
        F.when(i % 31 == 0, i - 1).otherwise(i).alias("receipt_id"), "license", (i * 10).alias("started_ns"), (i * 10 + F.when(i % 37 == 0, -5).otherwise(5)).alias("received_ns"), F.when(i % 41 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("payload"),
        F.crc32(F.col("text").cast("binary")).alias("crc"), F.when(i % 43 == 0, F.lit("00")).otherwise(F.sha2("text", 256)).alias("digest"),
    )
    commits = docs.where(i % 47 != 0).select(i.alias("receipt_id"))
    return journal.receipt_problems(stored, commits).groupBy("receipt_id").agg(F.concat_ws(", ", F.sort_array(F.collect_list(F.coalesce("problem", F.lit("none"))))).alias("problems"))


def journal_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "select @div(seq - 1, 1000) as batch, case when seq % 3331 = 0 then seq + 1000000 else seq end as sequence, concat(cast(user_id as varchar(12)), event_type, cast(k as varchar(12))) as key from ticks")
    return journal.batch_integrity(events)


def appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of seven events against a journal of the first half: the whole batch goes where a key is known, stands twice or an event has no number."""
    known = view(spark, sf_dir, "select user_id, event_type, k from ticks where seq % 2 = 0 and k < 5")
    new = view(spark, sf_dir, "select @div(seq, 7) as batch, seq as ordinal, case when seq % 501 = 0 then 0 else seq end as event_id, user_id, event_type, k, day from ticks where seq % 2 = 1")
    firsts = new.groupBy("batch").agg(F.min("day").alias("day"))
    return journal.appended_batches(known, new.drop("day").join(firsts, "batch"), key=["user_id", "event_type", "k"], cell="day", base=5000)


def committed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the batches that have a commit row: a batch that was cut off leaves nothing."""
    events = view(spark, sf_dir, "select @div(seq - 1, 1000) as batch, seq from ticks")
    commits = view(spark, sf_dir, "select distinct @div(seq - 1, 1000) as batch from ticks where seq % 3000 <> 1")
    return events.join(commits, "batch", "left_semi").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def replay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "select @div(seq - 1, 1000) as batch, seq as sequence, recv_ns as effective_ns, px as value from ticks where k % 11 <> 0")
    return journal.replay_reports(events, F.lit(1_705_500_000_000_000_000))


def replay_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the events that each instrument's replay passes on, in order; an instrument's events meet in no task."""
    events = view(spark, sf_dir, "select inst, seq as sequence, recv_ns as effective_ns, px as value from ticks where k % 11 <> 0 and recv_ns <= 1705500000000000000")
    line = F.concat_ws(":", "sequence", "effective_ns", "value")
    return journal.ordered_digest(events.withColumn("cell", F.expr("sequence div 512")), on=["inst"], cell="cell", order="sequence", line=line)


TYPED = "select seq as source_event_id, case seq % 7 when 0 then 'index' when 1 then 'quote' when 2 then 'bar' when 3 then 'observation' when 4 then 'positioning' when 5 then 'release' else 'note' end as kind, k % 6 as quality, ts_ns as event_ns, recv_ns - 5000000000 as received_ns, px as a, px + k - 3 as b, case when seq % 5 = 0 then null else px - k + 90 end as c, px + 2 as d, case when seq % 7 = 2 then ts_ns - (k - 1) * 60000000000 else k - 1 end as e, k % 9 as f from ticks"


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every kind with the time at which they become known, and what is wrong with them."""
    rows = view(spark, sf_dir, TYPED).withColumn("effective_ns", journal.effective_ns(F.col("kind"), F.col("quality"), F.col("event_ns"), F.col("received_ns")))
    return rows.select(F.col("source_event_id").alias("seq"), "effective_ns", journal.typed_problem().alias("problem"))


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags with the time quality in bits 8 to 10, in a live and in a replaying desk."""
    rows = view(spark, sf_dir, "select seq, k % 8 * 256 + k % 32 as flags, case when seq % 9 = 0 then 'replay' else 'live' end as mode from ticks")
    state = journal.availability(F.col("mode"), F.col("flags"))
    quality = scalars.time_quality(F.col("flags")).cast("long")
    return rows.select("seq", state.alias("availability"), journal.has_value(state).alias("has_value"), quality.alias("quality"), *[scalars.flag(F.col("flags"), b).alias(f"bit{b}") for b in range(4)])


def complete_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh for each order, of its lines: every line number to three must be there once, with status 200."""
    receipts = view(spark, sf_dir, "select l_orderkey as refresh_id, l_linenumber as code, case when l_partkey % 40 = 0 then 500 else 200 end as status from @table(lineitem) where l_linenumber <= 4")
    expected = view(spark, sf_dir, "select distinct l_linenumber as code from @table(lineitem) where l_linenumber <= 3")
    return journal.complete_refreshes(receipts, expected)


def bound_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names bound to codes by the longest prefix."""
    parts = view(spark, sf_dir, "select p_partkey, concat(p_type, ' ', p_brand) as title from @table(part)")
    prefixes = view(spark, sf_dir, "select distinct substring(p_type, 1, 4) as prefix, 1 as code from @table(part) union select distinct substring(p_type, 1, 2) as prefix, 2 as code from @table(part) where p_partkey % 3 = 0 union select distinct concat(p_type, ' ', substring(p_brand, 1, 7)) as prefix, 3 as code from @table(part) where p_partkey % 5 = 0")
    return journal.bound_titles(parts, prefixes, title="title").select("p_partkey", "code")


def venue_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of an account and instrument that is valid when an order is placed: each has one a quarter, with a gap."""
    orders = view(spark, sf_dir, "select o_orderkey, o_custkey % 9 as account, o_orderkey % 4 as inst, @micros(o_orderdate) * 1000 as ts_ns from @table(orders)")
    contracts = view(spark, sf_dir, f"select account, inst, q * 90 * {DAY} as from_ns, (q * 90 + 80) * {DAY} as to_ns, account * 10000 + inst * 1000 + q as contract from (select distinct o_custkey % 9 as account, o_orderkey % 4 as inst, @div(@micros(o_orderdate), 7776000000000) as q from @table(orders)) c")
    return joins.interval_join(orders, contracts, on=["account", "inst"], at="ts_ns", start="from_ns", end="to_ns", cell=30 * DAY).select("o_orderkey", "contract")


def tick_tier_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick of each part's price, from a venue's tiers as it writes them; every seventh part has one tick for all prices."""
    parts = view(spark, sf_dir, "select part, mid from tiers")
    tiers = '{"d": {"tickSize": [{"leftRangeLimit": null, "tickSize": "1"}, {"leftRangeLimit": 100000, "tickSize": 5}, {"leftRangeLimit": "140000", "tickSize": "10"}, {"leftRangeLimit": 180000, "tickSize": 25}, {"leftRangeLimit": 150000, "tickSize": 0}]}}'
    payload = F.when(F.col("part") % 7 == 0, '{"d": {"priceIncrement": "0.25"}}').when(F.col("part") % 7 == 1, '{"d": {"tickSize": 2}}').otherwise(tiers)
    return parts.select("part", "mid", venue.tick_size(payload, F.col("mid").cast("double")).alias("tick"))


def slot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = journal.slots(view(spark, sf_dir, "select inst, s_open, open_ns from m4"), 240_000_000_000)
    return found.groupBy("inst", "s_open").agg(F.count(F.lit(1)).alias("slots"), F.count(F.when(F.col("there"), 1)).alias("bars"), F.coalesce(F.sum(F.when(~F.col("there"), F.col("slot"))), F.lit(0)).alias("sum_gaps"))


def material_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "select @div(ordinal, 3) as batch, ordinal, kind, @div(ordinal, 3 * 5) % 4 + case when ordinal % 100 = 0 then 1 else 0 end as source, case when ordinal % 90 = 1 then ordinal - 5 else ordinal end as sequence, received_ns, stream = 1 as corrected from office_events")
    return journal.material_batches(events)


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = view(spark, sf_dir, "select source as dataset, doc_id % 3 as source, case when doc_id % 97 = 0 then 'personal' when doc_id % 2 = 0 then 'licensed' else 'open' end as license, doc_id as start_ns, doc_id + case when doc_id % 89 = 1 then -1 else n_chars end as end_ns from @table(documents)")
    return journal.manifest(segments, "research")


def opened_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = view(spark, sf_dir, "select l_suppkey as epoch, l_orderkey as opened_by from @table(lineitem)")
    orders = view(spark, sf_dir, "select l_suppkey as epoch, l_orderkey as order_id from @table(lineitem) where l_partkey % 150 <> 0")
    return journal.orphan_positions(positions, orders)


def epoch_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = view(spark, sf_dir, "select user_id % 7 as account, day, day * 100 + @div(k, 20) as epoch, case when seq % 19 = 0 then 'refused' end as problem from ticks")
    return journal.epoch_transactions(entries, on=["account"], cell="day").select("account", "epoch", "committed", "shown")


def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.counted(view(spark, sf_dir, "select kind, status, recorded_ns, last_sequence from drafts"))


def ledger_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.page_counts(view(spark, sf_dir, "select entry_id, kind, case when entry_id % 6 = 0 then 'rejected' else status end as status, case when entry_id % 5 = 0 then 0 else case_id end as case_id from drafts"))


def all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and final orders as one list, each with where it comes from."""
    mine = view(spark, sf_dir, "select o_orderkey, o_custkey, o_orderstatus from @table(orders)")
    open_ = mine.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", F.lit("open").alias("book"))
    final = mine.where("o_orderstatus = 'F'").select(F.lit("final").alias("book"), "o_custkey", "o_orderkey")
    return open_.unionByName(final).groupBy("book", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("newest"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scaling, ratios, thresholds, distances, precision, keys and formats over the events."""
    rows = view(spark, sf_dir, "select seq, k, px, inst, ts_ns, cast(px as double) / 100 as x from ticks")
    c, lit = F.col, lambda n: F.lit(n).cast("long")
    return rows.select(
        "seq",
        scalars.scale_exact(c("x"), 100).alias("exact"), scalars.scale_exact(c("x") / 3, 100).alias("inexact"), scalars.micros(c("x")).alias("micros"), scalars.nanos(c("x")).alias("nanos"),
        scalars.decimal_precision(c("x")).cast("long").alias("precision"), scalars.ratio_ppm(c("px"), c("k") - 5).alias("ppm"), scalars.merge_threshold(c("px"), c("k"), c("inst")).alias("threshold"),
        scalars.interval_distance(c("px"), c("px") + c("k"), lit(500), lit(700)).alias("distance"), scalars.midpoint(c("px"), c("px") + c("k")).alias("middle"), scalars.millis_to_ns(c("k") - 9, c("ts_ns")).alias("ms_ns"),
        scalars.used_share(c("x"), (c("k") - 3).cast("double")).alias("used"), scalars.valid_strategy_id(F.concat(F.lit("s"), F.repeat(F.lit("ab."), (c("k") % 14).cast("int")), F.when(c("k") % 10 == 0, " ").otherwise(""))).alias("strategy"),
        scalars.signed(c("px") * 10_000 - 5_000_000).alias("money"), scalars.rotated(c("ts_ns"), 17).bitwiseXOR(c("k")).alias("grp"), scalars.active_at(lit(300), F.when(c("k") % 2 == 0, lit(900)), c("px")).alias("active"),
        (scalars.event_id("tick", c("seq")) != 0).alias("has_id"), F.unix_seconds(scalars.eastern_to_utc(F.timestamp_seconds(F.expr("ts_ns div 1000000000")))).alias("utc_s"),
    )


def keys_and_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of ledger entries, saturating sums and products, and numbers and times as pages write them."""
    rows = view(spark, sf_dir, "select seq, k, px, inst, user_id, ts_ns, case when k % 3 = 0 then 0 else seq + 7 end as position from ticks")
    c, large = F.col, F.lit(9_223_372_036_854_770_000)
    side = F.when(c("k") % 3 == 0, "buy").when(c("k") % 3 == 1, "sell")
    return rows.select(
        "seq", scalars.lifecycle_correlation(c("user_id"), c("position"), c("seq")).alias("lifecycle"), scalars.key128(F.lit("order"), c("seq"), F.when(c("k") % 2 == 0, c("px"))).alias("source_key"),
        scalars.saturating_add(large, c("px") * (c("k") - 2)).alias("added"), scalars.saturating_multiply(c("ts_ns"), c("k") - 2).alias("multiplied"), scalars.side_label(side).alias("side"), scalars.fixed(c("px") / 8, 3).alias("price"), scalars.civil_utc(c("ts_ns")).alias("at"),
    )


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and quarters in the nine ways providers write them, and one that none does."""
    day = F.make_date(F.col("y").cast("int"), F.col("m").cast("int"), F.lit(1))
    months = view(spark, sf_dir, "select distinct year(o_orderdate) as y, month(o_orderdate) as m from @table(orders)")
    y, q, two = F.col("y").cast("string"), F.expr("cast((m + 2) div 3 as string)"), F.lpad(F.col("m").cast("string"), 2, "0")
    labels = [F.concat(y, F.lit("Q"), q), F.concat(y, F.lit("-Q"), q), F.concat(y, F.lit(" Q"), q), F.concat(y, F.lit("M"), two), F.concat(y, F.lit("-"), two), F.concat(y, two), F.upper(F.date_format(day, "yyyy MMM")), F.date_format(day, "dd MMM yyyy"), F.date_format(day, "yyyy-MM-dd"), F.concat(two, F.lit("/"), y)]
    rows = months.select("y", "m", F.posexplode(F.array(*labels)).alias("form", "label"))
    return rows.select(F.col("y").cast("long").alias("y"), F.col("m").cast("long").alias("m"), F.col("form").cast("long").alias("form"), decoders.period_start(F.col("label")).cast("string").alias("start"))


def price_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest session range of the days before that holds a price: ranges are listed by day, so ticks meet those of their day only."""
    ticks = view(spark, sf_dir, "select seq, inst, day, px from ticks")
    ranges = view(spark, sf_dir, "select inst, s_open, max(h) as hi, min(l) as lo from m4 group by inst, s_open")
    first = F.expr(f"s_open div {DAY}")
    listed = ranges.withColumn("day", F.explode(F.sequence(first, first + 3)))
    begun = F.col("day") * DAY - F.col("s_open")
    listed = listed.where((begun >= 0) & (begun < 3 * DAY))
    met = ticks.join(listed, ["inst", "day"]).where(F.col("px").between(F.col("lo"), F.col("hi")))
    best = F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "s_open"))
    return met.groupBy("seq").agg(best.alias("b"), F.count(F.lit(1)).alias("n_nodes")).select("seq", F.col("b.s_open").alias("node"), F.col("b.width").alias("width"), "n_nodes")


def reconciled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position that each order's fills lead to."""
    orders = view(spark, sf_dir, "select o_custkey as epoch, o_orderkey as ordinal, o_orderkey as order_id, 'working' as status, cast(0 as bigint) as filled, o_orderkey * 2 as position_id from @table(orders)")
    fills = view(spark, sf_dir, "select o_custkey as epoch, l_orderkey * 8 + l_linenumber as fill_id, l_orderkey as order_id, l_orderkey * 8 + l_linenumber as position_id, max(cast(round(l_quantity) as bigint)) as qty, l_orderkey * 8 + l_linenumber as ordinal from @table(lineitem) l join @table(orders) o on l.l_orderkey = o.o_orderkey group by o_custkey, l_orderkey, l_linenumber")
    return order_states(orders, fills).select("order_id", "position_id", "filled")


def level_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of the producers, a few of them spoilt: what the book refuses."""
    log = structure.mutations(view(spark, sf_dir, "select inst, s_open, s_close, open_ns, close_ns, o, h, l, c from m4"))
    spoilt = log.withColumn("upper", F.when(F.col("generation") % 97 == 0, F.col("price") - 1).otherwise(F.col("upper"))).where("not (kind = 'created' and level_id % 31 = 0)")
    return levels.violations(spoilt).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def location_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where ticks stand against the nodes of the session ranges of their day, and how far, in prices and in millionths of the range of an average bar."""
    ticks = view(spark, sf_dir, "select seq, inst, day, px from ticks")
    m4 = view(spark, sf_dir, f"select inst, @div(s_open, {DAY}) as day, minutes, max(h) as high, min(l) as low, cast(count(*) as bigint) as n, cast(sum(h - l) as bigint) as total from bars where minutes >= 120 group by inst, @div(s_open, {DAY}), minutes")
    node = F.struct(F.col("minutes").alias("node"), F.col("low").alias("low"), (F.col("low") + F.expr("(high - low) div (minutes div 60)")).alias("high"), (F.col("low") + F.expr("(high - low) div (2 * (minutes div 60))")).alias("center"))
    known = m4.groupBy("inst", "day").agg(F.sort_array(F.collect_list(F.struct(node["center"].alias("k"), node.alias("x")))).alias("all"), F.max(F.when(F.col("minutes") == 120, F.expr("total div n"))).alias("atr"))
    known = known.select("inst", F.col("day").alias("day"), F.transform("all", lambda a: a["x"]).alias("nodes"), "atr")
    located = nodes.locate(ticks.join(written(known, "location-nodes"), ["inst", "day"]), atr="atr")
    return located.select("seq", "place", "lower_node", "upper_node", "to_lower", "to_upper", "to_lower_ppm", "to_upper_ppm")


QUERIES = {
    f.__name__: f
    for f in (
        replay_hash, receipt_integrity, journal_integrity, appended_batches, committed_events, replay_report, typed_events, availability, complete_refreshes, bound_titles, venue_contracts, tick_tier_asof, slot_bars, material_batches, export_manifest,
        opened_positions, epoch_transactions, ledger_counts, ledger_kpis, all_orders, scalar_functions, keys_and_formats, period_labels, price_location, reconciled_positions, level_violations, location_distances,
    )
}

ORACLES = {
    # The fold itself, line by line.
    "replay_hash": """
        , lines as (select inst, list(md5(seq || ':' || recv_ns || ':' || px) order by seq) as ls from ticks where k % 11 <> 0 and recv_ns <= 1705500000000000000 group by inst)
        select inst, len(ls) as n, lpad(lower(to_hex(list_reduce(list_transform(ls, lambda m: cast(cast('0x' || substr(m, 1, 8) as bigint) as hugeint) % 2147483647), lambda h, x: (h * 1103515245 + x) % 2147483647, cast(0 as hugeint)))), 8, '0') || lpad(lower(to_hex(list_reduce(list_transform(ls, lambda m: cast(cast('0x' || substr(m, 9, 8) as bigint) as hugeint) % 2147483629), lambda h, x: (h * 1812433253 + x) % 2147483629, cast(0 as hugeint)))), 8, '0') || lpad(lower(to_hex(list_reduce(list_transform(ls, lambda m: cast(cast('0x' || substr(m, 17, 8) as bigint) as hugeint) % 2147483587), lambda h, x: (h * 1664525 + x) % 2147483587, cast(0 as hugeint)))), 8, '0') || lpad(lower(to_hex(list_reduce(list_transform(ls, lambda m: cast(cast('0x' || substr(m, 25, 8) as bigint) as hugeint) % 2147483579), lambda h, x: (h * 69069 + x) % 2147483579, cast(0 as hugeint)))), 8, '0') as digest from lines""",
    "receipt_integrity": """
        , s as (select doc_id, case when doc_id % 31 = 0 then doc_id - 1 else doc_id end as rid, doc_id * 10 + case when doc_id % 37 = 0 then -5 else 5 end as received, case when doc_id % 43 = 0 then '00' else sha256(text) end as digest from documents),
        n as (select *, row_number() over (partition by rid order by received, digest) as nth from s)
        select rid as receipt_id, string_agg(p, ', ' order by p) as problems from (select rid, case when rid % 47 = 0 or rid not in (select doc_id from documents) then 'not committed' when doc_id % 41 = 0 then 'checksum' when doc_id % 43 = 0 then 'digest'
        when nth > 1 then 'duplicate id' when doc_id % 8 = 3 then 'license' when doc_id % 37 = 0 then 'time order' else 'none' end as p from n) x group by rid""",
    "journal_integrity": """
        , e as (select (seq - 1) // 1000 as batch, case when seq % 3331 = 0 then seq + 1000000 else seq end as s, concat(user_id, event_type, k) as key from ticks),
        b as (select batch, min(s) as first_seq, max(s) as last_seq, count(*) as n, count(distinct key) as keys from e group by batch)
        select batch, first_seq, last_seq, n, last_seq - first_seq + 1 = n as dense, first_seq = coalesce(lag(last_seq) over (order by batch), 0) + 1 as joined, n - keys as repeated from b""",
    "appended_batches": """
        , new as (select seq // 7 as batch, seq, user_id, event_type, k from ticks where seq % 2 = 1), known as (select distinct user_id, event_type, k from ticks where seq % 2 = 0 and k < 5),
        bad as (select batch from new where seq % 501 = 0 union select batch from new group by batch, user_id, event_type, k having count(*) > 1 union select batch from new join known using (user_id, event_type, k)),
        good as (select batch, seq, 5000 + row_number() over (order by batch, seq) as sequence from new where batch not in (select batch from bad))
        select n.batch, n.seq as ordinal, g.sequence is not null as accepted, g.sequence from new n left join good g on n.batch = g.batch and n.seq = g.seq""",
    "committed_events": "select (seq - 1) // 1000 as batch, count(*) as n, max(seq) as last_seq from ticks group by 1 having count(*) filter (where seq % 3000 <> 1) > 0",
    "replay_report": """
        , fit as (select (seq - 1) // 1000 as batch, seq, recv_ns, px, seq - row_number() over (partition by (seq - 1) // 1000 order by seq) as run from ticks where k % 11 <> 0 and recv_ns <= 1705500000000000000)
        select batch, count(*) as n, count(distinct run) as runs, min(seq) as first_seq, max(seq) as last_seq, sha256(string_agg(concat(seq, ':', recv_ns, ':', px), chr(10) order by seq)) as digest from fit group by batch""",
    "typed_events": f"""
        , t as ({TYPED}), e as (select *, case when kind = 'quote' or quality = 1 or (quality = 2 and kind in ('index', 'bar')) then received_ns else event_ns end as effective_ns from t)
        select source_event_id as seq, effective_ns, case when kind = 'note' then 'kind' when kind = 'quote' and a > b then 'crossed quote' when kind = 'bar' and (e < 0 or event_ns <= e) then 'bar window' when kind = 'bar' and f = 0 then 'bar timeframe'
        when kind = 'bar' and (c > b or b < greatest(a, d) or c > least(a, d)) then 'bar prices' when kind = 'observation' and c is null then 'no value' when kind = 'observation' and a >= b then 'observation identity'
        when kind = 'positioning' and (b < 0 or c < 0 or d < 0 or e <= 0) then 'positioning counts' when effective_ns < received_ns and quality in (1, 2) then 'known before received' end as problem from e""",
    "availability": """
        select seq, case when seq % 9 = 0 then 'replaying' when k % 8 = 1 then 'live' when k % 8 = 2 then 'delayed' else 'stale' end as availability, true as has_value, case when k % 8 > 4 then 0 else k % 8 end as quality,
        k % 2 = 1 as bit0, k // 2 % 2 = 1 as bit1, k // 4 % 2 = 1 as bit2, k // 8 % 2 = 1 as bit3 from ticks""",
    "complete_refreshes": """
        , r as (select l_orderkey, count(*) as n, count(distinct l_linenumber) filter (where l_linenumber <= 3) as codes, bool_or(l_linenumber = 4) as strange, bool_or(l_partkey % 40 = 0) as failed from lineitem where l_linenumber <= 4 group by l_orderkey),
        p as (select *, case when failed then 'status' when strange then 'unknown code' when n > codes then 'duplicate code' when codes < 3 then 'missing code' end as problem from r)
        select l_orderkey as refresh_id, problem is null as complete, problem from p""",
    "bound_titles": """
        , px as (select distinct substr(p_type, 1, 4) as prefix, 1 as code from part union select distinct substr(p_type, 1, 2), 2 from part where p_partkey % 3 = 0 union select distinct concat(p_type, ' ', substr(p_brand, 1, 7)), 3 from part where p_partkey % 5 = 0)
        select p_partkey, (select arg_max(code, length(prefix) * 10 + code) from px where starts_with(concat(p_type, ' ', p_brand), prefix)) as code from part""",
    "venue_contracts": """
        , o as (select o_orderkey, o_custkey % 9 as account, o_orderkey % 4 as inst, epoch_us(o_orderdate) // 86400000000 as d from orders)
        select o_orderkey, account * 10000 + inst * 1000 + d // 90 as contract from o where d % 90 < 80""",
    "tick_tier_asof": "select part, mid, case when part % 7 = 0 then 0.25 when part % 7 = 1 then 2.0 when mid >= 180000 then 25.0 when mid >= 140000 then 10.0 when mid >= 100000 then 5.0 else 1.0 end::double as tick from tiers",
    "slot_bars": """
        , s as (select inst, s_open, count(*) as bars, max((open_ns - s_open) // 240000000000) as last_slot, sum((open_ns - s_open) // 240000000000) as total from m4 group by inst, s_open)
        select inst, s_open, last_slot + 1 as slots, bars, cast(last_slot * (last_slot + 1) // 2 - total as bigint) as sum_gaps from s""",
    "material_batches": """
        , e as (select ordinal // 3 as batch, ordinal, kind, ordinal // 15 % 4 + case when ordinal % 100 = 0 then 1 else 0 end as src, case when ordinal % 90 = 1 then ordinal - 5 else ordinal end as s, received_ns, stream = 1 as corrected,
          case kind when 'observation' then 'observations' when 'positioning' then 'positioning' when 'release' then 'provenance' when 'document' then 'provenance' end as family from office_events),
        r as (select *, lag(s) over (partition by batch, family order by ordinal) as before from e),
        fine as (select batch from r group by batch having min(src) = max(src) and count(*) filter (where family is null or s <= coalesce(before, s - 1) or s <= 0) = 0)
        select batch, family, min(s) as first_seq, max(s) as last_seq, max(received_ns) as received_ns, count(*) as n, count(*) filter (where corrected) as corrections from r where batch in (select batch from fine) group by batch, family""",
    "export_manifest": """
        select source as dataset, count(distinct doc_id % 3) as sources, min(doc_id) as start_ns, max(doc_id + case when doc_id % 89 = 1 then -1 else n_chars end) as end_ns,
        case when bool_or(doc_id % 97 = 0) then 'license' when bool_or(doc_id % 89 = 1) then 'time range' end as problem from documents group by source""",
    "opened_positions": """
        , known as (select distinct l_suppkey, l_orderkey from lineitem where l_partkey % 150 <> 0)
        select l.l_suppkey as epoch, bool_and(k.l_orderkey is not null) as accepted, count(*) as n from lineitem l left join known k on l.l_suppkey = k.l_suppkey and l.l_orderkey = k.l_orderkey group by l.l_suppkey""",
    "epoch_transactions": """
        , e as (select user_id % 7 as account, day * 100 + k // 20 as epoch, bool_and(seq % 19 <> 0) as committed from ticks group by 1, 2)
        select account, epoch, committed, max(case when committed then epoch end) over (partition by account order by epoch) as shown from e""",
    "ledger_counts": """
        select count(*) filter (where kind not in ('operator_note', 'intervention', 'review', 'amendment', 'redaction')) as machine, count(*) filter (where kind in ('operator_note', 'intervention', 'review', 'amendment', 'redaction')) as operator,
        count(*) filter (where kind = 'incident' or status = 'incident') as incidents, max(recorded_ns) as published_ns, max(coalesce(last_sequence, 0)) as last_sequence from drafts""",
    "ledger_kpis": """
        select count(*) filter (where kind = 'decision') as decisions, count(*) filter (where kind = 'order') as routed, count(*) filter (where entry_id % 6 = 0) as blocked, count(*) filter (where kind = 'fill') as fills,
        count(*) filter (where kind in ('intent', 'order', 'fill', 'position', 'exit') and (entry_id % 5 = 0 or case_id = 0)) as unknown_n from (select * from drafts order by entry_id desc limit 256) v""",
    "all_orders": "select case o_orderstatus when 'O' then 'open' else 'final' end as book, o_custkey, count(*) as n, max(o_orderkey) as newest from orders where o_orderstatus in ('O', 'F') group by all",
    "scalar_functions": """
        select seq, px as exact, case when px % 3 = 0 then px // 3 end as inexact, px * 10000 as micros, px * 10000000 as nanos, case when px % 100 = 0 then 0 when px % 10 = 0 then 1 else 2 end as precision,
        case when k > 5 then cast(trunc(px * 1000000 / (k - 5)) as bigint) else 0 end as ppm, greatest(greatest(px, 0) * 80000 // 1000000, k, inst * 2) as threshold, greatest(500 - px - k, px - 700, 0) as distance, px + k // 2 as middle,
        case when k > 9 then (k - 9) * 1000000 else ts_ns end as ms_ns, case when k > 3 then greatest(least(px / 100.0 / (k - 3), 1.0), 0.0) end as used, k % 10 <> 0 and 1 + 3 * (k % 14) <= 31 as strategy, printf('%+.2f', (px * 10000 - 5000000) / 1e6) as money,
        xor(cast((cast(ts_ns as hugeint) * 131072 % 18446744073709551616 + ts_ns // 140737488355328) - case when cast(ts_ns as hugeint) * 131072 % 18446744073709551616 >= 9223372036854775808 then 18446744073709551616 else 0 end as bigint), k) as grp,
        px >= 300 and (k % 2 = 1 or px < 900) as active, true as has_id, ts_ns // 1000000000 + 18000 as utc_s from ticks""",
    "keys_and_formats": """
        select seq, left(sha256(case when k % 3 = 0 then concat('["lifecycle","', user_id, '","order","', seq, '"]') else concat('["lifecycle","', user_id, '","position","', seq + 7, '"]') end), 32) as lifecycle,
        left(sha256(case when k % 2 = 0 then concat('["order","', seq, '","', px, '"]') else concat('["order","', seq, '",null]') end), 32) as source_key,
        cast(least(cast(9223372036854770000 as hugeint) + px * (k - 2), 9223372036854775807) as bigint) as added, cast(greatest(least(cast(ts_ns as hugeint) * (k - 2), 9223372036854775807), -9223372036854775808) as bigint) as multiplied,
        case k % 3 when 0 then 'BUY' when 1 then 'SELL' else 'UNKNOWN' end as side, printf('%.3f', px / 8.0) as price, strftime(make_timestamp(ts_ns // 1000000000 * 1000000), '%Y-%m-%d %H:%M:%S UTC') as at from ticks""",
    "period_labels": """
        , m as (select distinct cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m from orders)
        select y, m, form, cast(case when form < 3 then make_date(y, (m - 1) // 3 * 3 + 1, 1) when form < 9 then make_date(y, m, 1) end as varchar) as start from m cross join (select unnest(range(10)) as form) f""",
    "price_location": """
        select t.seq, min_by(n.s_open, @order(n.hi - n.lo, n.s_open)) as node, min(n.hi - n.lo) as width, count(*) as n_nodes from ticks t join (select inst, s_open, max(h) as hi, min(l) as lo from m4 group by inst, s_open) n
        on t.inst = n.inst and t.px >= n.lo and t.px <= n.hi and t.day * 86400000000000 >= n.s_open and t.day * 86400000000000 - n.s_open < 3 * 86400000000000 group by t.seq""",
    "reconciled_positions": """
        , f as (select l_orderkey, l_linenumber, max(cast(round(l_quantity) as bigint)) as qty from lineitem group by l_orderkey, l_linenumber), t as (select l_orderkey, sum(qty) as qty, max(l_linenumber) as last_line from f group by l_orderkey)
        select o_orderkey as order_id, case when last_line is null then o_orderkey * 2 else o_orderkey * 8 + last_line end as position_id, cast(coalesce(qty, 0) as bigint) as filled from orders left join t on l_orderkey = o_orderkey""",
    "location_distances": f"""
        , r as (select inst, s_open // {DAY} as day, minutes, max(h) as hi, min(l) as lo, cast(sum(h - l) as bigint) // count(*) as mean from bars where minutes >= 120 group by 1, 2, 3),
        nd as (select inst, day, minutes as node, lo as low, lo + (hi - lo) // (minutes // 60) as high, lo + (hi - lo) // (2 * (minutes // 60)) as center from r), a as (select inst, day, mean as atr from r where minutes = 120),
        t as (select k.seq, k.inst, k.day, k.px, a.atr from ticks k join a on k.inst = a.inst and k.day = a.day),
        inside as (select seq, arg_min(node, (high - low) * 1000 + node) as node, min(high - low) as w from t join nd on t.inst = nd.inst and t.day = nd.day and px between low and high group by seq),
        under as (select seq, arg_max(node, (center, low, node)) as node from t join nd on t.inst = nd.inst and t.day = nd.day and center < px group by seq),
        over_ as (select seq, arg_min(node, (center, low, node)) as node from t join nd on t.inst = nd.inst and t.day = nd.day and center >= px group by seq),
        b as (select t.*, i.node as i_node, u.node as u_node, o.node as o_node from t left join inside i using (seq) left join under u using (seq) left join over_ o using (seq)),
        d as (select b.*, case when i_node is not null then px - i.low when u_node is not null then greatest(px - u.high, 0) end as to_lower, case when i_node is not null then i.high - px when o_node is not null then greatest(o.low - px, 0) end as to_upper from b
          left join nd i on i.inst = b.inst and i.day = b.day and i.node = i_node left join nd u on u.inst = b.inst and u.day = b.day and u.node = u_node left join nd o on o.inst = b.inst and o.day = b.day and o.node = o_node)
        select seq, case when i_node is not null then 'inside' when u_node is null then 'below' when o_node is null then 'above' else 'between' end as place, coalesce(i_node, u_node) as lower_node, coalesce(i_node, o_node) as upper_node, to_lower, to_upper,
        case when atr > 0 then to_lower * 1000000 // atr end as to_lower_ppm, case when atr > 0 then to_upper * 1000000 // atr end as to_upper_ppm from d""",
}
