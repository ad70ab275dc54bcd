"""Canonical views over the given tables: ticks, sessions, bars, macro series, venue and ledger rows.

Money and prices are scaled integers, times are nanoseconds since the epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quayside.plans import dialect

VIEWS = {
    "ticks": """
        select event_id + 1 as seq, user_id % 6 + 1 as inst, @micros(ts) * 1000 as ts_ns, cast(round(value * 100) as bigint) as px,
               cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, event_type, user_id,
               @micros(ts) * 1000 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) * 1000000000 as recv_ns,
               @div(@micros(ts), 86400000000) as day
        from @table(events)""",
    "sessions": """
        select inst, day, day * 86400000000000 + (inst % 3) * 3600000000000 as open_ns, day * 86400000000000 + 81000000000000 as close_ns
        from (select distinct inst, day from ticks) d""",
    "in_session": """
        select t.*, s.open_ns as s_open, s.close_ns as s_close
        from ticks t join sessions s on t.inst = s.inst and t.day = s.day and t.ts_ns >= s.open_ns and t.ts_ns < s.close_ns""",
    "framed": """
        select i.*, minutes, s_open + @div(ts_ns - s_open, minutes * 60000000000) * minutes * 60000000000 as open_ns
        from in_session i @each(minutes, 4, 20, 120, 240)""",
    "bars": """
        select inst, cast(minutes as bigint) as minutes, s_open, s_close, open_ns, least(open_ns + minutes * 60000000000, s_close) as close_ns,
               min_by(px, @order(ts_ns, seq)) as o, max(px) as h, min(px) as l, max_by(px, @order(ts_ns, seq)) as c,
               count(*) as n, min_by(seq, @order(ts_ns, seq)) as first_seq, max_by(seq, @order(ts_ns, seq)) as last_seq
        from framed group by inst, minutes, s_open, s_close, open_ns""",
    "m4": "select * from bars where minutes = 4",
    "session_bars": """
        select inst, s_open, max(h) as hi, min(l) as lo, max_by(@order(h, o, c), @order(h, -open_ns)) as hi_bar, min_by(@order(l, o, c), @order(l, open_ns)) as lo_bar
        from m4 group by inst, s_open""",
    "quotes": "select seq, inst, ts_ns, px - (seq - 1) % 7 as bid, px + (seq - 1) % 5 as ask from ticks where event_type = 'view'",
    "macro_obs": """
        select o_orderkey as seq, o_orderpriority as series, cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as period,
               cast(round(o_totalprice * 100) as bigint) as v, o_custkey % 3 as source from @table(orders)""",
    "vintages": "select series, period, max_by(v, seq) as v, max(seq) as seq from macro_obs group by series, period",
    "positions": """
        select c_mktsegment as participant, cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as period,
               cast(sum(case when o_orderstatus = 'O' then cast(round(o_totalprice * 100) as bigint) else 0 end) as bigint) as long_q,
               cast(sum(case when o_orderstatus = 'F' then cast(round(o_totalprice * 100) as bigint) else 0 end) as bigint) as short_q
        from @table(orders) o join @table(customer) c on o.o_custkey = c.c_custkey group by 1, 2""",
    "nets": "select participant, period, long_q - short_q as net, row_number() over (partition by participant order by period desc) as r from positions",
    "fills": """
        select l_orderkey * 8 + l_linenumber as fill_id, l_orderkey as order_id, l_partkey % 6 + 1 as inst, cast(round(l_quantity * 1000000) as bigint) as qty,
               cast(round(l_extendedprice * 100) as bigint) as price, case l_returnflag when 'A' then 'buy' when 'R' then 'sell' else 'unknown' end as side from @table(lineitem)""",
    "entries": """
        select event_id + 1 as entry_id, user_id as case_id, event_id % 18 + 1 as kind, user_id % 97 as correlation, @micros(ts) * 1000 as event_ns,
               case when event_id % 5 = 0 then 0 else user_id % 6 + 1 end as inst, event_id % 4 = 0 as operator_entry, event_type as body,
               lag(event_id + 1) over (partition by user_id order by event_id) as parent_id from @table(events)""",
    "receipts": "select doc_id as receipt_id, source, doc_id % 4 as license, n_chars, text as payload from @table(documents)",
    "desk_events": """
        select seq as sequence, @div(seq - 1, 500) as batch, case event_type when 'view' then 'quote' when 'click' then 'index' when 'purchase' then 'bar' when 'signup' then 'heartbeat' end as kind,
               user_id % 8 + 1 as inst, user_id % 8 < 6 as known, ts_ns >= day * 86400000000000 + 3600000000000 and ts_ns < day * 86400000000000 + 81000000000000 as in_session,
               case k % 5 when 0 then 7 when 1 then 4 when 2 then 20 when 3 then 120 else 240 end as minutes, ts_ns - k % 7 * 3600000000000 as ts_ns, px as value from ticks""",
    "office_events": """
        select seq as ordinal, case when seq % 2500 = 1777 then seq - 900 else seq end as sequence, case event_type when 'view' then 'observation' when 'click' then 'positioning' when 'purchase' then 'release' when 'signup' then 'document' else 'quote' end as kind,
               @div(seq, 7) as receipt, user_id % 3 as office, user_id % 5 as source, k % 3 as stream, recv_ns as received_ns, day from ticks""",
    "reports": """
        select p_partkey % 4 as market, s_nationkey % 5 as participant, cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as report_date, l_orderkey * 8 + l_linenumber as sequence,
               cast(round(l_quantity * 10) as bigint) as long_q, cast(round(l_extendedprice) as bigint) % 700 as short_q
        from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as nth from @table(lineitem)) l
        join @table(orders) o on l.l_orderkey = o.o_orderkey join @table(part) p on l.l_partkey = p.p_partkey join @table(supplier) s on l.l_suppkey = s.s_suppkey where nth = 1""",
    "drafts": """
        select seq as entry_id, case when seq % 53 = 0 then 0 else seq % 4000 + 1 end as source_key, user_id % 20 as actor_id, case when seq % 4 = 0 then 'operator' else 'machine' end as actor_kind,
               case when seq % 61 = 0 then 0 else 1 end as schema_version, case seq % 15 when 0 then 'decision' when 1 then 'risk' when 2 then 'intent' when 3 then 'order' when 4 then 'fill' when 5 then 'position' when 6 then 'exit' when 7 then 'reconciliation' when 8 then 'incident' when 9 then 'operator_note' when 10 then 'intervention' when 11 then 'review' when 12 then 'amendment' when 13 then 'redaction' when 14 then 'note' end as kind, user_id as case_id,
               case when seq % 6 = 0 then seq - 7 when seq % 6 <= 2 then coalesce(lag(seq) over (partition by user_id order by seq), 0) when seq % 6 = 3 then seq + 100000000 else 0 end as parent_id,
               ts_ns as event_ns, ts_ns + (k - 3) * 1000000000 as received_ns, ts_ns + (k - 3) * 1000000000 + (seq % 40 - 1) * 1000 as recorded_ns,
               case when seq % 9 = 0 then seq % 7 end as first_sequence, case when seq % 9 = 0 then seq % 11 end as last_sequence, case when seq % 23 = 0 then '' when seq % 23 = 1 then '  ' else event_type end as body,
               case when seq % 10 = 0 then 'incident' else 'observed' end as status, case seq % 3 when 0 then 'none' when 1 then 'existing' else 'correlate' end as policy, user_id * 7 % 331 as correlation, day from ticks""",
    "gate_states": """
        select seq, user_id % 5 as desk, day, case seq % 11 when 0 then 'mode' when 1 then 'arm' when 2 then 'halt' when 3 then 'agreement' when 4 then 'mode' else case when seq % 2 = 0 then 'arm' else 'health' end end as command,
               case k % 4 when 0 then 'simulation' when 1 then 'shadow' when 2 then 'read_only' else 'live' end as mode, k % 29 <> 0 as data_fresh, k % 31 <> 1 as engine_ready, k % 37 <> 2 as venue_ready, k % 13 <> 3 as contracts_agree,
               k % 41 <> 4 as clock_synchronized, k % 43 <> 5 as reconciled, case when seq % 17 = 0 then null else k % 47 <> 6 end as no_unknown_orders from ticks""",
    "book_steps": """
        select seq, inst, user_id % 40 as slot, px, k, row_number() over (partition by inst order by seq) as n, row_number() over (partition by inst, user_id % 40 order by seq) as r from ticks""",
    "book_log": """
        select inst, @div(n - 1, 2) + 1 as generation, cast((n - 1) % 2 + 1 as int) as ordinal, case (r - 1) % 5 when 0 then 'created' when 3 then case when seq % 37 = 0 then 'updated' else 'frozen' end when 4 then 'expired' else 'updated' end as kind,
               case when seq % 1009 = 0 then 0 else slot + 1 + 1000 * @div(r - 1, 5) end as level_id, case when (r - 1) % 5 in (1, 2) and seq % 41 = 0 then px + 1 else px - k end as lower, px + k as upper, px as price, cast(slot % 2 as int) as side,
               cast(case when (r - 1) % 5 = 3 and seq % 37 = 0 then 9 else slot % 3 end as int) as family from book_steps""",
    "tiers": """
        select cast(p_partkey as bigint) as part, cast(round(p_retailprice * 100) as bigint) as mid, p_size from @table(part)""",
}


def needed_views(sql: str) -> list[str]:
    """The canonical views a query stands on, in order of definition."""
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                seen.add(name)
                visit(VIEWS[name])

    visit(sql)
    return [v for v in VIEWS if v in seen]


def full_sql(sql: str, d) -> str:
    """``sql`` with the views it needs before it; a text that begins with a comma has views of its own, which go on from there."""
    views = needed_views(sql)
    head = ",\n".join(f"{v} as ({VIEWS[v]})" for v in views)
    own = sql.lstrip()
    text = f"with {head}\n{own}" if head else f"with {own[1:]}" if own.startswith(",") else own
    return dialect.render(text, d)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the canonical views and the tables in ``sf_dir``."""
    return spark.sql(full_sql(sql, dialect.Spark(sf_dir)))
