"""SQL of the queries in ``tables``, which it does not share: the oracle of their rows, over the canonical views.

``@name(...)`` stands for what the dialects spell differently (dialect.py).
"""

ORACLES = {
    # Bars and replay.
    "ohlc_bars": "select inst, minutes, open_ns, close_ns, o, h, l, c, n, first_seq, last_seq from bars",
    "bars_partial_flag": "select inst, minutes, open_ns, close_ns, close_ns - open_ns < minutes * 60000000000 as partial_end, case when close_ns - open_ns < minutes * 60000000000 then 10 else 2 end as flags from bars",
    "bar_counts": "select minutes, count(*) as n_bars, cast(sum(n) as bigint) as n_ticks, min(open_ns) as first_open, max(close_ns) as last_close from bars group by minutes",
    "bars_emitted": "select b.inst, b.minutes, b.open_ns, b.c from bars b join (select max(ts_ns) as watermark from ticks) w on b.close_ns <= w.watermark",
    "late_revisions": """
        select f.inst, cast(f.minutes as bigint) as minutes, f.open_ns, cast(sum(case when f.recv_ns > least(f.open_ns + f.minutes * 60000000000, f.s_close) then 1 else 0 end) as bigint) as revision, count(*) as n
        from framed f group by f.inst, f.minutes, f.open_ns""",
    "rejected_ticks": "select t.seq, t.inst, t.ts_ns from ticks t left join in_session s on t.seq = s.seq where s.seq is null",
    "asof_replay": "select t.seq, t.inst, t.recv_ns, t.px from ticks t join (select min(ts_ns) + @div(max(ts_ns) - min(ts_ns), 2) as cutoff from ticks) c on t.recv_ns <= c.cutoff",
    "replay_islands": """
        select batch, run, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from
        (select batch, seq, seq - row_number() over (partition by batch order by seq) as run from (select @div(seq - 1, 1000) as batch, seq from ticks where k >= 30) e) r group by batch, run""",
    "dedup_events": "select user_id, event_type, k, min(seq) as seq, count(*) as copies from ticks group by user_id, event_type, k",
    "dup_batch_reject": """
        select batch, count(*) as n, cast(sum(case when r > 1 then 1 else 0 end) as bigint) as n_dup, sum(case when r > 1 then 1 else 0 end) = 0 as accepted
        from (select @div(seq - 1, 1000) as batch, row_number() over (partition by user_id, event_type, k order by seq) as r from ticks) d group by batch""",
    # Effective-dated joins.
    "session_interval_join": "select seq, inst, ts_ns, s_open, s_close, ts_ns - s_open as into_session from in_session",
    "symbol_scd2": """
        select t.seq, t.inst, b.symbol, b.version from ticks t join
        (select inst, concat('I:', cast(inst as varchar(8)), 'A') as symbol, cast(1 as bigint) as version, cast(0 as bigint) as from_ns, cast(1705276800000000000 as bigint) as to_ns from (select distinct inst from ticks) x
         union all select inst, concat('I:', cast(inst as varchar(8)), 'B'), 2, 1705276800000000000, 9000000000000000000 from (select distinct inst from ticks) y) b
        on t.inst = b.inst and t.ts_ns >= b.from_ns and t.ts_ns < b.to_ns""",
    "authority_reject": """
        select t.seq, t.inst, t.event_type from ticks t left join
        (select inst, case when inst % 2 = 0 then 'view' else 'click' end as owner from (select distinct inst from ticks) x) a
        on t.inst = a.inst and t.event_type = a.owner where a.inst is null""",
    "scd2_overlaps": """
        select o_custkey, o_orderkey, from_ns, prior_to from (select o_custkey, o_orderkey, from_ns, lag(to_ns) over (partition by o_custkey order by from_ns, o_orderkey) as prior_to from
        (select o_custkey, o_orderkey, @micros(o_orderdate) as from_ns, @micros(o_orderdate) + o_orderkey % 90 * 86400000000 as to_ns from @table(orders)) s) l where prior_to > from_ns""",
    "last_value": "select inst, max_by(px, seq) as px, max(seq) as seq, max_by(ts_ns, seq) as ts_ns from ticks group by inst",
    "last_quote": "select inst, max_by(bid, seq) as bid, max_by(ask, seq) as ask, max(seq) as seq from quotes group by inst",
    "quote_mid": "select seq, inst, bid, ask, @div(bid + ask, 2) as mid, bid <= ask as valid from quotes",
    "projector_health": """
        select inst, count(*) as n_seen, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as n_errors, cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as n_quotes,
        cast(sum(case when recv_ns < ts_ns then 1 else 0 end) as bigint) as n_early, max(recv_ns) as last_received from ticks group by inst""",
    "batch_availability": """
        select @div(seq - 1, 1000) as batch, case when max(case when event_type <> 'error' and k < 60 then 1 else 0 end) = 1 then 'live'
        else max_by(case when event_type = 'error' then 'stale' else 'delayed' end, seq) end as availability from ticks group by 1""",
    "flags_decode": "select seq, k % 2 = 1 as provisional, @div(k, 2) % 2 = 1 as final, @div(k, 4) % 2 = 1 as correction, @div(k, 8) % 2 = 1 as partial_end, case when @div(k, 16) % 8 >= 5 then 0 else @div(k, 16) % 8 end as quality from ticks",
    "license_matrix": "select receipt_id, license, license <> 0 as may_retain, license = 3 as may_export, license in (2, 3) as may_share from receipts",
    "license_rollup": "select source, license, count(*) as n, cast(sum(n_chars) as bigint) as chars from receipts group by source, license",
    "content_hash": "select receipt_id, md5(payload) as payload_md5, n_chars from receipts",
    "receipt_watermark": "select source, count(*) as n, max(receipt_id) as last_receipt, max(receipt_id) + 1 as next_receipt from receipts group by source",
    "json_props": "select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from @table(events)",
    # Macro series and positioning.
    "latest_vintage": "select series, period, v, seq from vintages",
    "macro_history36": "select series, period, v, cast(r as bigint) as r from (select series, period, v, row_number() over (partition by series order by period desc) as r from vintages) x where r <= 36",
    "macro_delta": "select series, period, v, v - lag(v) over (partition by series order by period) as delta from vintages",
    "macro_counts": "select series, count(*) as n, count(distinct period) as n_periods, count(distinct source) as n_sources, max(seq) as as_of from macro_obs group by series",
    "corrections": "select series, period, seq, v, prior, prior is not null and prior <> v as corrected from (select series, period, seq, v, lag(v) over (partition by series, period order by seq) as prior from macro_obs) x",
    "correction_rate": "select series, count(*) as n, cast(sum(case when prior is not null and prior <> v then 1 else 0 end) as bigint) as n_corrected from (select series, v, lag(v) over (partition by series, period order by seq) as prior from macro_obs) x group by series",
    "positioning_pct": """
        select n.participant, max(case when n.r = 1 then n.net end) as latest_net, count(*) as n_weeks, cast(sum(case when n.net <= x.latest then 1 else 0 end) as bigint) as n_below,
        round(100.0 * cast(sum(case when n.net <= x.latest then 1 else 0 end) as double) / cast(count(*) as double), 6) as pct
        from nets n join (select participant, net as latest from nets where r = 1) x on n.participant = x.participant where n.r <= 104 group by n.participant""",
    "positioning_hist104": "select participant, period, net, cast(r as bigint) as r from nets where r <= 104",
    "positioning_change": "select participant, period, net, net - lead(net) over (partition by participant order by r) as change from nets",
    "coverage": "select o_orderpriority as category, count(*) as cataloged, count(case when o_orderstatus = 'F' then 1 end) as current_n from @table(orders) group by o_orderpriority",
    "context_matrix": """
        select r.r_name as region, f.family, count(o.o_orderkey) as n, max(o.o_orderkey) as latest from @table(region) r cross join (select distinct o_orderpriority as family from @table(orders)) f
        left join (select n.n_regionkey, o.o_orderpriority, o.o_orderkey from @table(orders) o join @table(customer) c on o.o_custkey = c.c_custkey join @table(nation) n on c.c_nationkey = n.n_nationkey) o
        on o.n_regionkey = r.r_regionkey and o.o_orderpriority = f.family group by r.r_name, f.family""",
    "region_series_pick": "select n.n_regionkey as region, o.o_orderpriority as category, max(o.o_orderkey) as latest_key, max_by(o.o_custkey, o.o_orderkey) as latest_source from @table(orders) o join @table(customer) c on o.o_custkey = c.c_custkey join @table(nation) n on c.c_nationkey = n.n_nationkey group by 1, 2",
    "completeness": """
        select x.period, cast(5 - count(v.series) as bigint) as missing from (select distinct period from macro_obs) x left join (select distinct period, series from macro_obs) v on x.period = v.period group by x.period""",
    "unpivot_participants": "select participant, period, side, case side when 'long' then long_q when 'short' then short_q else long_q - short_q end as qty from positions @each(side, 'long', 'short', 'net')",
    # Venue.
    "unknown_orders": "select l.order_id, count(*) as n_fills from fills l left join (select o_orderkey from @table(orders) where o_orderkey % 10 <> 0) k on l.order_id = k.o_orderkey where k.o_orderkey is null group by l.order_id",
    "exposure": "select inst, cast(sum(case side when 'buy' then qty when 'sell' then -qty else 0 end) as bigint) as net_qty, cast(sum(case side when 'buy' then -price when 'sell' then price else 0 end) as bigint) as cash from fills group by inst",
    "fills_dedup": "select order_id, cast(sum(qty) as bigint) as filled, count(*) as n_fills from (select fill_id, max(order_id) as order_id, max(qty) as qty from fills group by fill_id) f group by order_id",
    "recon_orphans": "select f.fill_id, count(*) as n from fills f left join @table(orders) o on f.order_id = o.o_orderkey and o.o_orderstatus <> 'P' where o.o_orderkey is null group by f.fill_id",
    "order_status": "select o.o_orderkey, o.o_orderstatus, case when f.n is null then 'working' else 'partially_filled' end as state from @table(orders) o left join (select order_id, count(*) as n from fills group by order_id) f on o.o_orderkey = f.order_id",
    "contract_join": "select f.inst, p.p_brand, count(*) as n, cast(sum(f.qty) as bigint) as qty from (select l_partkey, l_partkey % 6 + 1 as inst, cast(round(l_quantity * 1000000) as bigint) as qty from @table(lineitem)) f join @table(part) p on f.l_partkey = p.p_partkey group by 1, 2",
    "limit_utilisation": "select c_custkey, round(greatest(least(c_acctbal / 9000.0, 1.0), 0.0), 9) as used from @table(customer)",
    # Ledger.
    "ledger_rows256": "select entry_id, case_id, kind, event_ns from entries order by entry_id desc limit 256",
    "ledger_cases": """
        select case_id, max(entry_id) as last_entry, max_by(event_ns, entry_id) as last_event_ns, max_by(kind, entry_id) as last_kind, max_by(body, entry_id) as preview, count(*) as n,
        coalesce(max_by(inst, case when inst <> 0 then entry_id end), 0) as inst from entries group by case_id""",
    "case_correlation": "select correlation, min_by(case_id, entry_id) as first_case, min(entry_id) as first_entry, count(distinct case_id) as n_cases from entries group by correlation",
    "parent_case_violations": "select e.entry_id, e.parent_id from entries e left join entries p on e.parent_id = p.entry_id and p.kind < e.kind where e.parent_id is not null and p.entry_id is null",
    "causal_neighbours": "select e.entry_id, e.parent_id, count(c.entry_id) as n_children from entries e left join entries c on c.parent_id = e.entry_id group by e.entry_id, e.parent_id",
    "body_preview": "select receipt_id, trim(regexp_replace(substring(payload, 1, 180), '[ \t\n\r]+', ' '@everywhere())) as preview from receipts",
    "idempotent_append": "select source_key, min(entry_id) as kept, count(*) as attempts from (select entry_id, case_id * 100 + kind as source_key from entries) e group by source_key",
    # Structure of the market.
    "session_extremes": """
        select inst, open_ns, h, l, ph is null or h > ph as new_high, pl is null or l < pl as new_low from
        (select inst, open_ns, h, l, max(h) over (partition by inst, s_open order by open_ns rows between unbounded preceding and 1 preceding) as ph,
        min(l) over (partition by inst, s_open order by open_ns rows between unbounded preceding and 1 preceding) as pl from m4) x""",
    "extreme_bands": """
        select inst, s_open, hi, max_by(greatest(o, c), @order(h, -open_ns)) as upper_low, lo, min_by(least(o, c), @order(l, open_ns)) as lower_high from
        (select inst, s_open, open_ns, o, h, l, c, max(h) over (partition by inst, s_open) as hi, min(l) over (partition by inst, s_open) as lo from m4) x group by inst, s_open, hi, lo""",
    "prev_session": "select inst, s_open, hi, lo, lag(hi) over (partition by inst order by s_open) as prev_hi, lag(lo) over (partition by inst order by s_open) as prev_lo from (select inst, s_open, max(h) as hi, min(l) as lo from m4 group by inst, s_open) s",
    "opening_range": """
        select inst, s_open, max(h) as hi, min(l) as lo, min(l) + @div(max(h) - min(l), 2) as mid, count(*) as n from
        m4 where open_ns < s_open + 1200000000000 group by inst, s_open""",
    "level_ids": "select inst, s_open, 281474976710656 + inst * 4294967296 + case when r = 1 then 1 else 4 + (r - 2) * 6 + 1 end as first_id from (select inst, s_open, cast(dense_rank() over (partition by inst order by s_open) as bigint) as r from (select distinct inst, s_open from m4) d) x",
    "corridors": """
        select inst, center, next_center, greatest(next_low - hi, 0) as width, case when hi = lo then 0 else @div(greatest(next_low - hi, 0) * 1000000, hi - lo) end as ppm from
        (select inst, s_open, lo, hi, lo + @div(hi - lo, 2) as center, lead(lo) over (partition by inst order by lo, hi, s_open) as next_low, lead(lo + @div(hi - lo, 2)) over (partition by inst order by lo, hi, s_open) as next_center from
        (select inst, s_open, max(h) as hi, min(l) as lo from m4 group by inst, s_open) s) x where next_low is not null""",
    "slot_gaps": "select inst, s_open, @div(open_ns - s_open, 240000000000) as slot, @div(open_ns - s_open, 240000000000) - coalesce(lag(@div(open_ns - s_open, 240000000000)) over (partition by inst, s_open order by open_ns), -1) - 1 as missing_before from m4",
    "visible_extent": "select inst, s_open, min(l) as lo, max(h) as hi, min(l) - greatest(@div((max(h) - min(l)) * 9, 100), 1) as floor_px, max(h) + greatest(@div((max(h) - min(l)) * 9, 100), 1) as top_px from m4 group by inst, s_open",
    "bar_upsert": "select inst, minutes, open_ns, max_by(c, last_seq) as c, count(*) as versions from (select inst, minutes, open_ns, c, last_seq from bars union all select inst, minutes, open_ns, o, first_seq - 1 from bars) u group by inst, minutes, open_ns",
}
