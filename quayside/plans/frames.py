"""Queries built from the DataFrame operators, and SQL over the canonical views for the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayside.operators import joins, levels, nodes, structure
from quayside.plans import tables
from quayside.plans.views import view
from quayside.sources import series_store, shared
from quayside.streaming import bars, ledger, office
from quayside.streaming import structure as live

HOUR = 3_600_000_000_000


def interval_join_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = view(spark, sf_dir, "select seq, inst, ts_ns from ticks")
    sessions = view(spark, sf_dir, "select inst, open_ns, close_ns from sessions")
    return joins.interval_join(ticks, sessions, on=["inst"], at="ts_ns", start="open_ns", end="close_ns", cell=24 * HOUR)


def asof_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = view(spark, sf_dir, "select seq, inst, ts_ns, px from ticks")
    quotes = view(spark, sf_dir, "select inst, ts_ns, bid, ask from quotes")
    return joins.asof_join(ticks, quotes, on=["inst"], left_at="ts_ns", right_at="ts_ns", take=["bid", "ask"], cell=24 * HOUR)


def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "select o_custkey, o_orderkey, @micros(o_orderdate) as from_us, @micros(o_orderdate) + o_orderkey % 90 * 86400000000 as to_us from @table(orders)")
    return joins.overlaps(spans, on=["o_custkey"], start="from_us", end="to_us", by=("o_orderkey",))


def _m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.m4_of(spark, sf_dir).select("inst", "s_open", "s_close", "open_ns", "close_ns", "o", "h", "l", "c")


def _text(numbers: str) -> Column:
    return F.array_join(F.transform(F.sort_array(numbers), lambda n: n.cast("string")), ",")


def structure_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every level that the bars give rise to."""
    return levels.versions(structure.mutations(_m4(spark, sf_dir)))


def structure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes after each bar that changed a level."""
    return _shown(structure.structure(_m4(spark, sf_dir)).select("inst", "generation", "at_ns", F.inline("nodes")))


def _shown(found: DataFrame) -> DataFrame:
    families = F.array_distinct(F.transform("members", lambda m: F.shiftright(m, 48)))
    return found.withColumn("families", families).withColumns({c: _text(c) for c in ("sides", "members", "families")})


def node_genealogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.structure(_m4(spark, sf_dir)).select("inst", "generation", "bar_ns", F.inline("events"))
    return found.withColumn("others", _text("others"))


def node_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.corridors(structure.structure(_m4(spark, sf_dir)))


def price_in_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick against the nodes known when it came: those after the last bar closed by then."""
    known = structure.structure(_m4(spark, sf_dir)).select("inst", "at_ns", "generation", "atr", "nodes")
    ticks = view(spark, sf_dir, "select seq, inst, ts_ns, px from ticks")
    met = joins.asof_join(ticks, known, on=["inst"], left_at="ts_ns", right_at="at_ns", take=["at_ns", "generation", "nodes"], cell=24 * HOUR)
    return nodes.locate(met.withColumnRenamed("asof_nodes", "nodes")).drop("nodes", "asof_at_ns")


#: Days of arrivals that the stream gets at a time.
ARRIVALS = 8
_TICKS = f"select seq, inst, ts_ns, px, day * 86400000000000 + inst % 3 * 3600000000000 as s_open, day * 86400000000000 + 81000000000000 as s_close, @div(day - 19723 + case when k % 10 = 0 then 2 else 0 end, {ARRIVALS}) as arrival from ticks"


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Ticks arrive in turns, some two days late; after each the stream goes on from its checkpoint with what is new."""
    folder = os.path.join(shared.folder(spark), f"bars-{uuid.uuid4().hex}")
    ticks = view(spark, sf_dir, _TICKS)
    turns = [r[0] for r in ticks.select("arrival").distinct().orderBy("arrival").collect()]
    for turn in turns:
        ticks.where(F.col("arrival") == turn).drop("arrival").write.parquet(f"{folder}/in/turn={turn}")
        stream = spark.readStream.schema(ticks.drop("arrival").schema).parquet(f"{folder}/in/*")
        bars.stream_bars(stream, folder).awaitTermination()
    return folder


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every emission of a stream over all events: bars of four timeframes, and their corrections."""
    return spark.read.schema(bars.EMITTED).parquet(f"{_streamed(spark, sf_dir)}/emitted")


def live_equals_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose last live emission differs from the replayed history: none."""
    emitted = spark.read.schema(bars.EMITTED).parquet(f"{_streamed(spark, sf_dir)}/emitted")
    values = ["close_ns", "o", "h", "l", "c", "n"]
    last = emitted.groupBy(*bars.KEY).agg(F.max_by(F.struct(*values), "batch").alias("live"))
    whole = bars.replayed(view(spark, sf_dir, _TICKS)).select(*bars.KEY, F.struct(*values).alias("replay"))
    return last.join(whole, bars.KEY, "full").where(~F.col("live").eqNullSafe(F.col("replay"))).select(*bars.KEY)


def in_turns(spark: SparkSession, rows: DataFrame, start: Callable[[DataFrame, str], StreamingQuery], label: str) -> str:
    """The folder of a stream that gets ``rows`` by their column turn; in each, ``start`` goes on from the state that the last one left."""
    folder = os.path.join(shared.folder(spark), f"{label}-{uuid.uuid4().hex}")
    rows.write.partitionBy("turn").parquet(f"{folder}/all")
    every = spark.read.parquet(f"{folder}/all")
    for (n,) in every.select("turn").distinct().orderBy("turn").collect():
        every.where(F.col("turn") == n).drop("turn").write.parquet(f"{folder}/in/turn={n}")
        start(spark.readStream.schema(rows.drop("turn").schema).parquet(f"{folder}/in/*"), folder).awaitTermination()
    return folder


OFFICE = "select office, ordinal, sequence, kind, receipt, source, stream, received_ns, case kind when 'observation' then source * 3 + stream else source end as name, day % 23 as period, received_ns % 1000 as a, ordinal % 700 as b, @div(ordinal * 3, (select max(ordinal) + 1 from office_events)) as turn from office_events"


def _office_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = in_turns(spark, view(spark, sf_dir, OFFICE), lambda stream, at: office.stream_office(stream, at, weeks=12), "office")
    return spark.read.parquet(f"{folder}/emitted")


def streamed_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the offices add up to after the last turn of their stream."""
    return office.latest(_office_stream(spark, sf_dir))


def streamed_office_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest vintages and the last reports that the offices hold after the last turn."""
    return office.points(_office_stream(spark, sf_dir))


COMMANDS = """
    select entry_id as ordinal, case_id * 15 + entry_id % 5 * 3 + case policy when 'none' then 0 when 'existing' then 1 else 2 end as source_key, policy, case_id, correlation, case when entry_id % 4 = 0 then @div(entry_id, 40) end as epoch,
           case when entry_id % 61 = 0 then 'missing identity' end as problem, day as cell, @div(entry_id * 3, (select max(seq) + 1 from ticks)) as turn from drafts"""


def ledger_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each command that was appended to the ledger, batch by batch, outside epochs."""
    commands = view(spark, sf_dir, COMMANDS).withColumn("epoch", F.lit(None).cast("bigint")).withColumn("cell", F.expr("ordinal div 512"))
    folder = in_turns(spark, commands, ledger.stream_ledger, "ledger")
    return ledger.snapshot(spark, folder, "outcomes").drop("batch")


def epoch_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with epochs, each of which is appended whole or not at all: what the ledger holds in the end."""
    commands = view(spark, sf_dir, COMMANDS).where("policy = 'none'").withColumn("cell", F.expr("ordinal div 512")).withColumn("source_key", F.col("ordinal"))
    folder = in_turns(spark, commands, ledger.stream_ledger, "epochs")
    return ledger.snapshot(spark, folder).select("entry_id", "ordinal", "epoch")


UPSERTS = [
    "select inst, minutes, open_ns, close_ns, o, h, l, c, n, last_seq as version from bars where minutes >= 20 and open_ns % 7 <> 0",
    "select inst, minutes, open_ns, close_ns, o, h, l, case when n > 1 then c + 1 else c end as c, n, last_seq as version from bars where minutes >= 20 and @div(open_ns, 86400000000000) % 3 = 0",
]


def series_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second of two upserts into stored series changes, with the bars as they are then."""
    folder = os.path.join(shared.folder(spark), f"series-{uuid.uuid4().hex}")
    for text in UPSERTS:
        changes = series_store.upsert(spark, folder, view(spark, sf_dir, text))
    now = series_store.bars(spark, folder)
    told = changes.select("inst", "minutes", "open_ns", "kind")
    return now.join(told, ["inst", "minutes", "open_ns"], "left").select("inst", "minutes", "open_ns", "c", "n", F.coalesce("kind", F.lit("kept")).alias("kind"))


#: Days whose bars and prices a turn of the structural stream brings.
TURN = 16


def _structure_stream(spark: SparkSession, sf_dir: str, prices: bool) -> DataFrame:
    """What the structural stream emits, given its bars (and prices) in turns; each turn goes on from the state that the last one left."""
    every = live.moves(_m4(spark, sf_dir), view(spark, sf_dir, "select inst, seq, ts_ns, px from ticks") if prices else None)
    folder = in_turns(spark, every.withColumn("turn", F.expr(f"at_ns div {24 * HOUR} div {TURN}")), live.stream_structure, "structure")
    return spark.read.parquet(f"{folder}/emitted")


def streamed_structure_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of all levels as a stream of bars emits them in turns."""
    return live.level_versions(_structure_stream(spark, sf_dir, False))


def streamed_structure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes after each bar that changed a level, as a stream of bars emits them in turns."""
    emitted = _structure_stream(spark, sf_dir, False).where(F.col("kind") == live.BAR)
    return _shown(emitted.select("inst", "generation", "at_ns", F.inline("nodes")))


def streamed_price_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick against the live graph, which its bars change on the same stream."""
    return live.placed_prices(_structure_stream(spark, sf_dir, True)).drop("late")


QUERIES = {f.__name__: f for f in (series_upserts, ledger_appends, epoch_appends, streamed_office, streamed_office_points, streamed_structure_levels, streamed_structure_nodes, streamed_price_places, interval_join_cells, asof_quotes, overlapping_orders, structure_levels, structure_nodes, node_genealogy, node_corridors, price_in_structure, streamed_bars, live_equals_replay)}

ORACLES = {
    "series_upserts": f"""
        , first_ as ({UPSERTS[0]}), second_ as ({UPSERTS[1]})
        select coalesce(s.inst, f.inst) as inst, coalesce(s.minutes, f.minutes) as minutes, coalesce(s.open_ns, f.open_ns) as open_ns, coalesce(s.c, f.c) as c, coalesce(s.n, f.n) as n,
        case when f.inst is null then 'insert' when s.inst is null then 'kept' when f.c = s.c then 'none' else 'replace' end as kind
        from first_ f full join second_ s on f.inst = s.inst and f.minutes = s.minutes and f.open_ns = s.open_ns""",
    "ledger_appends": f"""
        , commands as ({COMMANDS}), first_of as (select * from commands where problem is null qualify row_number() over (partition by source_key order by ordinal) = 1),
        firsts as (select correlation, min(ordinal) as first_at, arg_min(policy, ordinal) as how, arg_min(case_id, ordinal) as asked from first_of where policy <> 'none' and correlation <> 0 group by correlation),
        opened as (select correlation, 999999 + row_number() over (order by first_at) as fresh from firsts where how = 'correlate'),
        cases as (select f.correlation, case when how = 'existing' then asked else fresh end as c from firsts f left join opened o on f.correlation = o.correlation),
        judged as (select f.*, cast(case policy when 'none' then 0 when 'existing' then case when c is null or c = case_id then case_id end else c end as bigint) as assigned from first_of f left join cases s on f.correlation = s.correlation),
        taken as (select source_key, ordinal as at, assigned, row_number() over (order by ordinal) as entry_id from judged where assigned is not null)
        select ordinal, case when t.at is null or ordinal < t.at then 'refused' when ordinal = t.at then 'appended' else 'existing' end as outcome,
        case when ordinal >= t.at then t.entry_id end as entry_id, case when ordinal >= t.at then t.assigned end as assigned
        from commands c left join taken t on c.source_key = t.source_key""",
    "epoch_appends": f"""
        , commands as (select ordinal, epoch, problem from ({COMMANDS}) c where policy = 'none'), bad as (select distinct epoch from commands where problem is not null and epoch is not null),
        taken as (select ordinal, epoch from commands where problem is null and (epoch is null or epoch not in (select epoch from bad)))
        select row_number() over (order by ordinal) as entry_id, ordinal, epoch from taken""",
    "streamed_office_points": f"""
        , rows_ as ({OFFICE}), mine as (select * from rows_ where kind in ('observation', 'positioning', 'release', 'document')),
        risen as (select *, max(sequence) over (partition by office order by ordinal rows between unbounded preceding and 1 preceding) as before from mine),
        stops as (select office, min(ordinal) as stop from risen where sequence <= coalesce(before, 0) group by office),
        taken as (select m.* from mine m left join stops s on m.office = s.office where s.stop is null or m.ordinal < s.stop),
        held as (select office, kind, name, period, arg_max(a, sequence) as a, arg_max(b, sequence) as b, max(sequence) as sequence from taken where kind in ('observation', 'positioning') group by office, kind, name, period)
        select office, kind, name, period, a, b, sequence from held qualify kind = 'observation' or row_number() over (partition by office, kind, name order by period desc) <= 12""",
    "interval_join_cells": "select seq, inst, ts_ns, s_open as open_ns, s_close as close_ns from in_session",
    "asof_quotes": """
        select t.seq, t.inst, t.ts_ns, t.px, max_by(q.bid, @order(q.ts_ns, q.bid, q.ask)) as asof_bid, max_by(q.ask, @order(q.ts_ns, q.bid, q.ask)) as asof_ask
        from ticks t left join (select inst, ts_ns, bid, ask, coalesce(lead(ts_ns) over (partition by inst order by ts_ns, bid, ask), 9000000000000000000) as next_ns from quotes) q
        on t.inst = q.inst and t.ts_ns >= q.ts_ns and t.ts_ns < q.next_ns group by t.seq, t.inst, t.ts_ns, t.px""",
    "overlapping_orders": """
        select o_custkey, o_orderkey, from_us, to_us, prior_end from (select *, max(to_us) over (partition by o_custkey order by from_us, to_us rows between unbounded preceding and 1 preceding) as prior_end from
        (select o_custkey, o_orderkey, @micros(o_orderdate) as from_us, @micros(o_orderdate) + o_orderkey % 90 * 86400000000 as to_us from @table(orders)) s) w where prior_end > from_us""",
    "live_equals_replay": "select inst, cast(minutes as integer) as minutes, open_ns from bars where false",
    "streamed_bars": f"""
        , arrivals as (select *, dense_rank() over (order by arrival) - 1 as batch from ({_TICKS}) a), marks as (select batch, max(ts_ns) as mark from arrivals group by batch),
        cut as (select inst, minutes, batch, seq, ts_ns, px, s_open + (ts_ns - s_open) // (minutes * 60000000000) * minutes * 60000000000 as open_ns, s_close from arrivals cross join (select unnest([4, 20, 120, 240]) as minutes) m where ts_ns >= s_open and ts_ns < s_close),
        grid as (select k.*, m.batch, m.mark from (select inst, minutes, open_ns, least(open_ns + minutes * 60000000000, any_value(s_close)) as close_ns from cut group by inst, minutes, open_ns) k join marks m on close_ns <= mark),
        upto as (select g.inst, g.minutes, g.open_ns, g.close_ns, g.batch, count(*) as n, arg_min(px, (ts_ns, seq)) as o, max(px) as h, min(px) as l, arg_max(px, (ts_ns, seq)) as c
                 from grid g join cut t on t.inst = g.inst and t.minutes = g.minutes and t.open_ns = g.open_ns and t.batch <= g.batch group by g.inst, g.minutes, g.open_ns, g.close_ns, g.batch),
        seen as (select *, lag(n) over w as before, first_value(n) over w as at_first from upto window w as (partition by inst, minutes, open_ns order by batch))
        select inst, cast(minutes as integer) as minutes, open_ns, close_ns, o, h, l, c, n, n - at_first as revision, before is not null as correction, batch from seen where before is null or n > before""",
}
