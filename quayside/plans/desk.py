"""Queries of the desk, the macro office, control and the chart; their SQL is written apart from the operators, from the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.scalars import whole_quotient
from quayside.operators import control, macro, market
from quayside.operators.structure import FRACTIONS
from quayside.plans import tables
from quayside.plans.views import view

HOUR = 3_600_000_000_000
NOW = 1_706_000_000_000_000_000


def desk_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.health(view(spark, sf_dir, "select batch, sequence, kind, known, in_session, minutes from desk_events"))


def desk_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.reference_values(view(spark, sf_dir, "select inst, sequence, kind, ts_ns, value from desk_events where known"))


def series_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars come four times: with the open as close, whole, whole again, and with the high as close."""
    bars = view(spark, sf_dir, "select inst, minutes, open_ns, o, h, l, c from bars")
    versions = F.array(*[F.struct(F.lit(i).alias("version"), F.col(c).alias("close")) for i, c in enumerate(("o", "c", "c", "h"))])
    return market.series_revisions(bars.select("inst", "minutes", "open_ns", "o", "h", "l", F.inline(versions)), ["o", "h", "l", "close"])


def bar_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar against the rules of one instrument's structure; some are spoilt by their number."""
    bars = view(spark, sf_dir, "select inst, minutes, open_ns, close_ns, o, h, l, c, first_seq, last_seq from bars")
    spoilt = bars.select(
        "inst", "minutes", "open_ns", F.when(F.col("first_seq") % 17 == 0, F.col("open_ns")).otherwise(F.col("close_ns")).alias("close_ns"), "o", "h",
        F.when(F.col("first_seq") % 19 == 0, F.col("o") + 1).otherwise(F.col("l")).alias("l"), "c",
        F.when(F.col("first_seq") % 23 == 0, F.lit(0)).otherwise(F.col("first_seq")).alias("first_seq"), "last_seq",
        F.when(F.col("first_seq") % 29 == 0, F.lit(6)).otherwise(F.lit(7)).alias("derivation"), F.when(F.col("first_seq") % 31 == 0, F.lit(2)).otherwise(F.lit(0)).alias("revision"),
    )
    return spoilt.select("inst", "minutes", "open_ns", market.bar_problem(F.lit(3), 7).alias("problem"))


def _m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.m4_of(spark, sf_dir).select("inst", "s_open", "s_close", "open_ns", "close_ns", "o", "h", "l", "c")


def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.true_ranges(_m4(spark, sf_dir)).select("inst", "open_ns", "tr")


def atr14(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = market.rolling(market.true_ranges(_m4(spark, sf_dir)), 14, total=F.sum("tr"), n=F.count("tr"))
    return ranged.select("inst", "open_ns", whole_quotient(F.col("total"), F.col("n")).alias("atr"))


def gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.gaps(_m4(spark, sf_dir)).select("inst", "open_ns", "gapped")


def range_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = market.rolling(_m4(spark, sf_dir), 20, hi=F.max("h"), lo=F.min("l"), n=F.count("h")).where("n >= 2")
    each = ranged.select("inst", "open_ns", "hi", "lo", F.explode(F.array(*[F.lit(f) for f in FRACTIONS])).alias("fraction"))
    return each.select("inst", "open_ns", "fraction", (F.col("lo") + whole_quotient((F.col("hi") - F.col("lo")) * F.col("fraction"), F.lit(1_000_000))).alias("price"))


def moving_avg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last eight closes, of as many as there are at the start."""
    summed = market.rolling(_m4(spark, sf_dir), 8, total=F.sum("c"), n=F.count("c"))
    return summed.select("inst", "open_ns", whole_quotient(F.col("total"), F.col("n")).alias("ma8"))


def macro_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.project(view(spark, sf_dir, "select * from office_events"), on=["office"], cell="day", order="ordinal")


def positioning_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.positioning(view(spark, sf_dir, "select * from reports"), weeks=12)


def positioning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.positioning_summary(view(spark, sf_dir, "select * from reports"), weeks=12)


def releases128(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = view(spark, sf_dir, "select o_orderkey as sequence, @micros(o_orderdate) as scheduled_ns from @table(orders)")
    return macro.release_tape(orders).select(F.col("sequence").alias("o_orderkey"), F.col("scheduled_ns").alias("scheduled"), F.col("place").alias("r"))


def macro_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = view(spark, sf_dir, "select concat(series, cast(source as varchar(8))) as series, period, seq as sequence, seq % 5 = 0 as corrected from macro_obs")
    releases = view(spark, sf_dir, "select ts_ns as scheduled_ns from ticks where event_type = 'signup'")
    return macro.board(series, releases, F.lit(NOW))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.by_category(view(spark, sf_dir, "select p_partkey as series, case p_size % 5 when 0 then 'inflation' when 1 then 'labor' when 2 then 'rates' when 3 then 'growth' else 'other' end as category from @table(part)"))


def latest_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.latest_provenance(view(spark, sf_dir, "select seq as sequence, series, period, v as value from macro_obs"))


_FEEDS = "select user_id as feed, max(recv_ns) as last_ns, (user_id % 24 + 1) * 3600000000000 as interval_ns from ticks group by user_id union all select c_custkey + 1000000 as feed, cast(null as bigint) as last_ns, 60000000000 as interval_ns from @table(customer) where c_custkey % 10 = 0"


def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.next_refresh(view(spark, sf_dir, _FEEDS), NOW)


def feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = view(spark, sf_dir, "select c_custkey as feed, c_custkey % 7 <> 0 as configured from @table(customer)")
    failures = view(spark, sf_dir, "select o_custkey as feed, @micros(o_orderdate) * 1000 as retry_ns from @table(orders) where o_orderkey % 9 = 0")
    published = view(spark, sf_dir, "select o_custkey as feed from @table(orders) where o_orderstatus = 'F' and o_orderkey % 4 = 0")
    received = view(spark, sf_dir, "select o_custkey as feed from @table(orders) where o_orderkey % 3 = 0")
    return macro.feed_states(catalogue, failures, published, received)


def live_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = control.gate(view(spark, sf_dir, "select * from gate_states"))
    return states.select("seq", "ready", F.concat_ws(", ", "reasons").alias("reasons"), F.size("reasons").cast("long").alias("n"))


def core_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = view(spark, sf_dir, "select * from gate_states where seq % 3 <> 0 or command <> 'health'")
    return control.modes(commands, on=["desk"], cell="day", order="seq").select("seq", "desk", "command", "after", "route")


_TERMS = ["multiplier", "minimum", "step"]


def contract_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    venue = view(spark, sf_dir, "select p_partkey as inst, p_size as multiplier, case when p_partkey % 4 = 0 then null else p_size % 3 end as minimum, p_partkey % 2 as step, p_partkey % 5 <> 0 as route_open, p_partkey % 7 <> 0 as session_open from @table(part)")
    cached = view(spark, sf_dir, "select p_partkey as inst, p_size as multiplier, case when p_partkey % 8 = 0 then null else p_size % 3 end as minimum, p_partkey % 2 as step from @table(part) where p_partkey % 6 <> 0")
    return control.contract_agreement(venue, cached, _TERMS)


_STATES = ("ready", "live", "delayed", "stale", "replaying", "invalid", "disconnected", "awaiting")
_STATE_SQL = " ".join(f"when {i} then '{s}'" for i, s in enumerate(_STATES))


def combined_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, f"select seq, case seq % 8 {_STATE_SQL} end as left_state, case k % 8 {_STATE_SQL} end as right_state from ticks")
    return rows.select("seq", control.combined(F.col("left_state"), F.col("right_state")).alias("state"))


def desk_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    instruments = view(spark, sf_dir, "select distinct p_size as inst from @table(part) union select 1000")
    positions = view(spark, sf_dir, "select p_size as inst, side, qty, price % 1001 - 500 as pnl from fills f join @table(part) p on f.order_id = p.p_partkey where p_size % 3 <> 0")
    return control.desk_exposure(instruments, positions)


def selection_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = view(spark, sf_dir, "select c_custkey as page, c_custkey % 50 + 1 as entry from @table(customer)")
    rows = view(spark, sf_dir, "select o_custkey as page, o_orderkey % 97 + 1 as entry, o_orderkey as place from @table(orders)")
    return control.repaired_selection(wanted, rows, on="page", item="entry", order="place")


def node_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation nodes by group, as the map of systems lists them."""
    nodes = view(spark, sf_dir, "select s_suppkey as node, n_name as grp, s_acctbal >= 0 as healthy from @table(supplier) s join @table(nation) n on s.s_nationkey = n.n_nationkey")
    listed = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("healthy"), 1)).alias("healthy"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))
    return listed.where("n > 0")


def gates_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.gates_passed(view(spark, sf_dir, "select o_custkey as strategy, o_orderpriority as gate, case o_orderstatus when 'F' then 'pass' when 'O' then 'open' else 'fail' end as status from @table(orders)"))


def account_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = view(spark, sf_dir, "select c_custkey as account, c_custkey % 700 + 100000 as number from @table(customer)")
    wanted = view(spark, sf_dir, "select o_orderkey as request, case when o_orderkey % 3 = 0 then o_custkey when o_orderkey % 3 = 1 then o_custkey + 50000000 end as account, case when o_orderkey % 5 = 0 then o_custkey % 900 + 100000 end as number from @table(orders)")
    return control.selected_account(accounts, wanted)


def chart_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that are visible before and after a zoom, for as many viewports as there are events."""
    rows = view(spark, sf_dir, "select seq, cast(k % 30 + 2 as double) as spacing, cast(seq % 40 as double) - 30.0 as scroll, 50 + seq % 400 as bars, cast(600 + k as double) as width, 0.5 + k / 64.0 as factor, (seq % 5) / 4.0 as anchor from ticks")
    c = F.col
    args = (c("spacing"), c("scroll"), c("bars"), c("width"))
    spacing, scroll = control.zoomed(*args, c("factor").cast("double"), c("anchor").cast("double"))
    moved = rows.withColumn("first_slot", control.visible_slots(*args)[0]).withColumn("end_slot", control.visible_slots(*args)[1]).withColumn("z", spacing).withColumn("s", control.clamped_scroll(scroll, c("bars")))
    after = control.visible_slots(c("z"), c("s"), c("bars"), c("width"))
    return moved.select("seq", "first_slot", "end_slot", F.round("z", 6).alias("zoomed_spacing"), F.round("s", 6).alias("zoomed_scroll"), (after[1] - after[0] >= 0).alias("in_order"))


QUERIES = {
    f.__name__: f
    for f in (
        desk_health, desk_reference, series_revisions, bar_gate, true_range, atr14, gap_flags, range_projection, moving_avg8, macro_office, positioning_weeks, positioning_summary, releases128, macro_board, category_counts,
        latest_provenance, refresh_plan, feed_state, live_gate, core_modes, contract_agreement, combined_availability, desk_exposure, selection_repair, node_groups, gates_passed, account_selection, chart_view,
    )
}

_BLOCKS = [("data_fresh", "data stale"), ("engine_ready", "engine not ready"), ("venue_ready", "venue not ready"), ("contracts_agree", "contract mismatch"), ("clock_synchronized", "clock unsynchronized"), ("reconciled", "reconciliation incomplete"), ("no_unknown_orders", "unknown order outcome")]
_ALL_HOLD = " and ".join(f"coalesce({c}, false)" for c, _ in _BLOCKS)
_SHOWN = """shown as (select *, row_number() over (partition by market, participant order by report_date desc) as age from
        (select market, participant, report_date, arg_max(long_q, sequence) as long_q, arg_max(short_q, sequence) as short_q from reports group by market, participant, report_date) v),
        kept as (select *, long_q - short_q as net, max(report_date) over (partition by market) as newest from shown where age <= 12)"""

ORACLES = {
    "desk_health": """
        select count(distinct batch) as batches, count(*) as events_seen, count(*) filter (where kind = 'index' and known) as reference_values, count(*) filter (where kind = 'quote' and known) as venue_quotes,
        count(*) filter (where kind = 'bar' and known and minutes <> 7) as external_bars, count(*) filter (where kind = 'heartbeat') as ignored_events, count(*) filter (where kind in ('index', 'quote', 'bar') and not known) as unknown_instruments,
        count(*) filter (where kind is null or (kind = 'bar' and known and minutes = 7)) as invalid_events, count(*) filter (where kind = 'index' and known and not in_session) as bar_rejections, max(sequence) as last_sequence from desk_events""",
    # The fold itself, one event after another.
    "desk_reference": """
        , numbered as (select inst, sequence, kind, ts_ns, value, row_number() over (partition by inst order by sequence) as i from desk_events where known and kind in ('index', 'bar')),
        fold as (with recursive walk as (
            select inst, i, value, ts_ns, sequence from numbered where i = 1
            union all
            select n.inst, n.i, case when n.kind = 'index' or n.ts_ns >= w.ts_ns then n.value else w.value end, case when n.kind = 'index' or n.ts_ns >= w.ts_ns then n.ts_ns else w.ts_ns end, case when n.kind = 'index' or n.ts_ns >= w.ts_ns then n.sequence else w.sequence end
            from walk w join numbered n on n.inst = w.inst and n.i = w.i + 1) select * from walk)
        select inst, arg_max(value, i) as value, arg_max(ts_ns, i) as ts_ns, arg_max(sequence, i) as sequence from fold group by inst""",
    "series_revisions": "select inst, minutes, count(*) as bars, cast(sum(1 + case when c <> o then 1 else 0 end + case when h <> c then 1 else 0 end) as bigint) as revision from bars group by inst, minutes",
    "bar_gate": """
        select inst, minutes, open_ns, case when inst <> 3 then 'instrument' when minutes <> 4 then 'timeframe' when first_seq % 29 = 0 then 'derivation' when first_seq % 31 = 0 then 'revised' when first_seq % 23 = 0 or last_seq < first_seq then 'not committed'
        when first_seq % 17 = 0 or first_seq % 19 = 0 then 'geometry' end as problem from bars""",
    "true_range": "select inst, open_ns, greatest(h - l, abs(h - coalesce(pc, h)), abs(l - coalesce(pc, l))) as tr from (select inst, open_ns, h, l, lag(c) over (partition by inst order by open_ns) as pc from m4) x",
    "atr14": """
        select inst, open_ns, @div(cast(sum(tr) over (partition by inst order by open_ns rows between 13 preceding and current row) as bigint), count(*) over (partition by inst order by open_ns rows between 13 preceding and current row)) as atr
        from (select inst, open_ns, greatest(h - l, abs(h - coalesce(pc, h)), abs(l - coalesce(pc, l))) as tr from (select inst, open_ns, h, l, lag(c) over (partition by inst order by open_ns) as pc from m4) x) y""",
    "gap_flags": """
        select inst, open_ns, cast(max(gap) over (partition by inst order by open_ns rows between unbounded preceding and current row) as bigint) as gapped from
        (select inst, open_ns, case when pclose is null and open_ns <> s_open then 1 when ps = s_open and open_ns > pclose then 1 when ps <> s_open and (pclose < p_end or open_ns > s_open) then 1 else 0 end as gap from
        (select inst, s_open, open_ns, lag(close_ns) over (partition by inst order by open_ns) as pclose, lag(s_open) over (partition by inst order by open_ns) as ps, lag(s_close) over (partition by inst order by open_ns) as p_end from m4) x) y""",
    "range_projection": """
        select inst, open_ns, fraction, lo + @div((hi - lo) * fraction, 1000000) as price from
        (select inst, open_ns, max(h) over w as hi, min(l) over w as lo, count(*) over w as n from m4 window w as (partition by inst order by open_ns rows between 19 preceding and current row)) x
        @each(fraction, 0, 213000, 333000, 500000, 666000, 750000, 900000, 1000000) where n >= 2""",
    "moving_avg8": "select inst, open_ns, cast(trunc(sum(c) over w / count(*) over w) as bigint) as ma8 from m4 window w as (partition by inst order by open_ns rows between 7 preceding and current row)",
    "macro_office": """
        , mine as (select *, max(sequence) over (partition by office order by ordinal rows between unbounded preceding and 1 preceding) as before from office_events where kind in ('observation', 'positioning', 'release', 'document')),
        stops as (select office, min(ordinal) as stop, arg_min(sequence, ordinal) as stopped_at from mine where sequence <= coalesce(before, 0) group by office)
        select m.office, count(*) filter (where stop is null or ordinal < stop) as events, count(*) filter (where (stop is null or ordinal < stop) and kind in ('observation', 'positioning')) as data_events,
        count(*) filter (where (stop is null or ordinal < stop) and kind = 'document') as documents, count(*) filter (where (stop is null or ordinal < stop) and kind = 'release') as releases,
        count(distinct receipt) filter (where stop is null or ordinal < stop) as receipts, count(distinct source * 10 + stream) filter (where stop is null or ordinal < stop) as feeds,
        coalesce(max(sequence) filter (where stop is null or ordinal < stop), 0) as last_sequence, coalesce(max(received_ns) filter (where stop is null or ordinal < stop), 0) as as_of_ns, any_value(stopped_at) as stopped_at
        from mine m left join stops s on m.office = s.office group by m.office""",
    "positioning_weeks": f", {_SHOWN} select market, participant, report_date, long_q, short_q, net, age, newest from kept",
    "positioning_summary": f"""
        , {_SHOWN}, latest as (select market, participant, any_value(newest) as newest, max(net) filter (where age = 1) as net, max(net) filter (where age = 2) as prior from kept group by market, participant)
        select k.market, k.participant, l.newest, l.net, l.net - l.prior as change, count(*) as n, round(100.0 * count(*) filter (where k.net <= l.net) / count(*), 6) as percentile
        from kept k join latest l on k.market = l.market and k.participant = l.participant group by all""",
    "releases128": "select o_orderkey, epoch_us(o_orderdate) as scheduled, row_number() over (order by o_orderdate desc, o_orderkey desc) as r from orders qualify r <= 128",
    "macro_board": f"""
        , latest as (select concat(series, source) as series, arg_max(seq % 5 = 0, period * 100000000000 + seq) as corrected from macro_obs group by 1)
        select count(*) as current_series, count(*) filter (where corrected) as corrected_series, (select min(ts_ns) from ticks where event_type = 'signup' and ts_ns >= {NOW}) as next_scheduled from latest""",
    "category_counts": "select count(*) filter (where p_size % 5 = 0) as inflation, count(*) filter (where p_size % 5 = 1) as labor, count(*) filter (where p_size % 5 = 2) as rates, count(*) filter (where p_size % 5 = 3) as growth from part",
    "latest_provenance": "select seq as sequence, series, period, v as value from macro_obs order by seq desc limit 1",
    "refresh_plan": f", feeds as ({_FEEDS}), due as (select feed, case when last_ns is null then {NOW} else greatest(last_ns + interval_ns, {NOW}) end as next_ns from feeds) select feed, next_ns, next_ns = (select min(next_ns) from due) as earliest from due".replace("from ticks", "from ticks").replace("@table(customer)", "customer"),
    "feed_state": """
        select c_custkey as feed, case when c_custkey % 7 = 0 then 'not_configured' when exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 9 = 0) then 'rejected'
        when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderkey % 4 = 0) then 'current' when exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 3 = 0) then 'rejected' else 'awaiting' end as state,
        case when c_custkey % 7 = 0 then 0 else coalesce((select max(epoch_us(o_orderdate)) * 1000 from orders where o_custkey = c_custkey and o_orderkey % 9 = 0), 0) end as retry_ns from customer""",
    "live_gate": f"select seq, {_ALL_HOLD} as ready, concat_ws(', ', {', '.join(f'''case when not coalesce({c}, false) then '{r}' end''' for c, r in _BLOCKS)}) as reasons, {' + '.join(f'cast(not coalesce({c}, false) as bigint)' for c, _ in _BLOCKS)} as n from gate_states",
    # The state machine itself, one command after another.
    "core_modes": f"""
        , picked as (select *, {_ALL_HOLD} as free, row_number() over (partition by desk order by seq) as i from gate_states where seq % 3 <> 0 or command <> 'health'),
        fold as (with recursive walk as (
            select desk, cast(0 as bigint) as i, cast(0 as bigint) as seq, '' as command, 'disconnected' as mode, false as free from (select distinct desk from picked) d
            union all
            select p.desk, p.i, p.seq, p.command, case p.command when 'mode' then case when p.mode = 'live' then w.mode else p.mode end when 'arm' then case when p.free then 'live' else w.mode end when 'halt' then 'halted'
              when 'agreement' then case when not p.contracts_agree and w.mode = 'live' then 'read_only' else w.mode end
              else case when w.mode = 'disconnected' then 'read_only' when w.mode = 'live' and not p.free then 'read_only' else w.mode end end, p.free
            from walk w join picked p on p.desk = w.desk and p.i = w.i + 1) select * from walk)
        select seq, desk, command, mode as after, case when mode = 'simulation' then 'simulate' when mode = 'shadow' then 'shadow only' when mode = 'live' and free then 'transmit' when mode = 'halted' then 'refused: halted' else 'refused: not armed' end as route from fold where i > 0""",
    "contract_agreement": "select p_partkey as inst, p_partkey % 5 <> 0 and p_partkey % 7 <> 0 and p_partkey % 6 <> 0 and (p_partkey % 8 = 0 or p_partkey % 4 <> 0) as agrees from part",
    "combined_availability": "select seq, case when seq % 8 < 5 and k % 8 < 5 then 'ready' when seq % 8 in (5, 6) or k % 8 in (5, 6) then 'invalid' else 'awaiting' end as state from ticks",
    "desk_exposure": """
        select i.inst, coalesce(sum(case side when 'buy' then qty when 'sell' then -qty else 0 end), 0)::bigint as net, coalesce(sum(price % 1001 - 500), 0)::bigint as pnl, case when coalesce(sum(case side when 'buy' then qty when 'sell' then -qty else 0 end), 0) = 0 then 'flat' else 'open' end as state
        from (select distinct p_size as inst from part union select 1000) i left join (select p_size, side, qty, price from fills f join part p on f.order_id = p.p_partkey where p_size % 3 <> 0) h on h.p_size = i.inst group by i.inst""",
    "selection_repair": """
        select c_custkey as page, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 97 + 1 = c_custkey % 50 + 1) then c_custkey % 50 + 1 else (select arg_min(o_orderkey % 97 + 1, o_orderkey) from orders where o_custkey = c_custkey) end as entry from customer""",
    "node_groups": "select n_name as grp, count(*) as n, count(*) filter (where s_acctbal >= 0) as healthy, min(s_suppkey) as first_node, max(s_suppkey) as last_node from nation join supplier on s_nationkey = n_nationkey group by n_name",
    "gates_passed": "select o_custkey as strategy, count(*) filter (where o_orderstatus = 'F') as passed, count(*) as n from orders group by o_custkey",
    "account_selection": """
        , asks as (select o_orderkey as request, case when o_orderkey % 3 = 0 then o_custkey when o_orderkey % 3 = 1 then o_custkey + 50000000 end as account, case when o_orderkey % 5 = 0 then o_custkey % 900 + 100000 end as number from orders),
        hits as (select request, count(distinct c_custkey) as n, min(c_custkey) as one from asks join customer on c_custkey = account or c_custkey % 700 + 100000 = number group by request)
        select a.request, case when h.n = 1 then h.one end as account, case when h.n is null then 'not found' when h.n > 1 then 'ambiguous' end as problem from asks a left join hits h on a.request = h.request""",
    "chart_view": """
        , v as (select seq, cast(k % 30 + 2 as double) as spacing, cast(seq % 40 as double) - 30.0 as scroll, 50 + seq % 400 as bars, cast(600 + k as double) as width, 0.5 + k / 64.0 as factor, (seq % 5) / 4.0 as anchor from ticks),
        f as (select *, bars - width / spacing + scroll as first_index, least(greatest(spacing * factor, 3.0), 24.0) as z from v),
        s as (select *, least(greatest(case when z = spacing then scroll else first_index + anchor * width / spacing - anchor * width / z - bars + width / z end, -bars), 6.0) as moved from f)
        select seq, cast(least(greatest(floor(first_index), 0), least(greatest(ceil(bars + scroll), 0), bars)) as bigint) as first_slot, cast(least(greatest(ceil(bars + scroll), 0), bars) as bigint) as end_slot, round(z, 6) as zoomed_spacing, round(moved, 6) as zoomed_scroll, true as in_order from s""",
}
#: A stream in turns gives what the whole history does.
ORACLES["streamed_office"] = ORACLES["macro_office"]
