"""Queries of the ledger and of the chart's structure; their SQL is written apart from the operators, from the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import ledger, levels, projection, structure
from quayside.plans import tables
from quayside.plans.views import view
from quayside.sources.shared import written

DRAFTS = "select * from drafts"


def draft_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.draft_problems(view(spark, sf_dir, DRAFTS), view(spark, sf_dir, "select entry_id, case_id from drafts"))
    return out.select("entry_id", "problem")


def automatic_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = view(spark, sf_dir, "select entry_id, source_key, actor_id, case when actor_kind = 'operator' and entry_id % 8 <> 0 then 'machine' else actor_kind end as actor_kind, kind, policy, case when case_id % 13 = 0 then 0 else case_id end as case_id, case when correlation % 17 = 0 then 0 else correlation end as correlation, event_ns, received_ns, schema_version, first_sequence, last_sequence, body from drafts")
    return ledger.automatic_problems(commands).select("entry_id", "problem")


def operator_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = view(spark, sf_dir, "select entry_id, source_key as command_key, body, case when entry_id % 71 = 0 then -1 else event_ns end as submitted_ns, kind, case entry_id % 4 when 0 then 'amend' when 1 then 'redact' else 'append' end as mutation, case when case_id % 13 = 0 then 0 else case_id end as case_id, parent_id from drafts")
    return ledger.operator_problems(commands, view(spark, sf_dir, "select entry_id, actor_kind from drafts")).select("entry_id", "problem")


def case_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = view(spark, sf_dir, "select entry_id as ordinal, policy, case_id, correlation, day from drafts")
    known = view(spark, sf_dir, "select distinct correlation, correlation + 500000 as case_id from drafts where correlation % 4 = 1")
    return ledger.assign_cases(commands, known, 1_000_000, cell="day").select("ordinal", "assigned", "conflict")


def ledger_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the documents' bodies; some refer to none, or to another length or digest."""
    headers = view(spark, sf_dir, "select doc_id as entry_id, case when doc_id % 19 = 0 then doc_id + 100000000 else doc_id end as body_id, case when doc_id % 23 = 0 then -1 else octet_length(@bytes(text)) end as body_len, case when doc_id % 29 = 0 then 'x' else md5(text) end as body_digest from @table(documents)")
    bodies = view(spark, sf_dir, "select doc_id as body_id, text as body from @table(documents)")
    return ledger.with_bodies(headers, bodies).select("entry_id", "problem", F.length("body").cast("long").alias("n_chars"))


def ledger_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ledger.by_family(view(spark, sf_dir, "select entry_id, kind from drafts"))
    return shown.groupBy("view", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("entry_id").alias("newest"))


def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.incidents(view(spark, sf_dir, DRAFTS)).select("entry_id", "kind", "status", "event_ns")


def top_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.top_decisions(view(spark, sf_dir, DRAFTS)).select("entry_id", "kind", "event_ns")


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = written(structure.mutations(tables.m4_of(spark, sf_dir).select("inst", "s_open", "s_close", "open_ns", "close_ns", "o", "h", "l", "c")), "books-log")
    return levels.active(levels.versions(log), log.select("inst", "generation").distinct())


def chart_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bands at the end of each day, as the chart shows them."""
    chart = projection.chart_structure(_active(spark, sf_dir))
    return chart.where("generation % 50 = 0")


def structure_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the active levels of every generation."""
    fields = ["level_id", "lower", "upper", "price", "group_id", "side", "family", "age", "state"]
    return projection.fingerprint(_active(spark, sf_dir), by=["inst", "generation"], order=["price", "level_id"], fields=fields, tag="levels/1")


BOOK_LOG = "select * from book_log"


def book_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a log of mutations, each judged by the one before it."""
    return levels.violations(view(spark, sf_dir, BOOK_LOG))


def book_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutations that a book applies which refuses whole generations, and what each leaves behind for those after it."""
    return levels.applied(view(spark, sf_dir, BOOK_LOG)).select("inst", "generation", "ordinal", "kind", "level_id", "lower", "upper", "price")


QUERIES = {f.__name__: f for f in (book_violations, book_replay, draft_validity, automatic_validity, operator_validity, case_assignment, ledger_bodies, ledger_views, incident_timeline, top_decisions, chart_structure, structure_fingerprint)}



def _rotated(value: str, bits: int, key: str) -> str:
    """A 64-bit number turned left and mixed with a key, in integers wide enough."""
    turned = f"(cast({value} as hugeint) * {1 << bits} % 18446744073709551616 + {value} // {1 << (64 - bits)})"
    return f"xor(cast({turned} - case when {turned} >= 9223372036854775808 then 18446744073709551616 else 0 end as bigint), cast({key} as bigint))"


_ID = "281474976710656"
#: What is active after every bar, from the bars themselves: the state that the log of mutations must lead to.
ACTIVE = f"""
    , ses as (select inst, s_open, min(s_close) as s_close, row_number() over (partition by inst order by s_open) as k, max(h) as hi, min(l) as lo, min(open_ns) as first_ns from m4 group by inst, s_open),
    run as (select b.*, s.k, s.first_ns, row_number() over (partition by b.inst order by b.open_ns) as nth, max(b.h) over w as rh, min(b.l) over w as rl, max(b.h) over p as ph, min(b.l) over p as pl,
            max(b.h) over r as wh, min(b.l) over r as wl, case when s.k = 1 then 0 else 6 * s.k - 6 end as base, least(b.s_open + 1200000000000, b.s_close) as form_end
            from m4 b join ses s on b.inst = s.inst and b.s_open = s.s_open
            window w as (partition by b.inst, b.s_open order by b.open_ns rows between unbounded preceding and current row), p as (partition by b.inst, b.s_open order by b.open_ns rows between unbounded preceding and 1 preceding),
                   r as (partition by b.inst order by b.open_ns rows between 19 preceding and current row)),
    moved as (select *, ph is null or h > ph as nh, pl is null or l < pl as nl, lag(wh) over (partition by inst order by open_ns) as lwh, lag(wl) over (partition by inst order by open_ns) as lwl,
              first_ns < s_open + 1200000000000 as has_range, open_ns < form_end as forming, open_ns >= form_end and lag(open_ns) over (partition by inst, s_open order by open_ns) < form_end as closes from run),
    counted as (select *, sum(cast(nh and ph is not null as bigint)) over u as h_age, sum(cast(nl and pl is not null as bigint)) over u as l_age, max(case when nh then open_ns end) over u as h_at, max(case when nl then open_ns end) over u as l_at,
                sum(cast(forming and has_range and ph is not null and (h > ph or l < pl) as bigint)) over u as r_age, max(case when forming then h end) over u as r_hi, min(case when forming then l end) over u as r_lo
                from moved window u as (partition by inst, s_open order by open_ns rows between unbounded preceding and current row)),
    fr as (select unnest([0, 213000, 333000, 500000, 666000, 750000, 900000, 1000000]) as f, unnest(range(8)) as i),
    proj as (select c.inst, c.open_ns, i, wl + (wh - wl) * f // 1000000 as price, nth = 2 or (nth > 2 and wl + (wh - wl) * f // 1000000 <> lwl + (lwh - lwl) * f // 1000000) as changed, nth from counted c cross join fr where nth >= 2),
    aged as (select *, sum(cast(changed and nth > 2 as bigint)) over (partition by inst, i order by open_ns) as p_age from proj),
    gens as (select c.inst, c.open_ns, dense_rank() over (partition by c.inst order by c.open_ns) as generation from counted c left join (select inst, open_ns, bool_or(changed) as any_moved from proj group by inst, open_ns) p on c.inst = p.inst and c.open_ns = p.open_ns
             where c.open_ns = c.first_ns or nh or nl or (has_range and (closes or (forming and (h > ph or l < pl)))) or coalesce(any_moved, false)),
    bands as (select x.inst, x.k, x.base, t.o as ho, t.h as hh, t.c as hc, u.o as lo_, u.l as ll, u.c as lc, x.h_age, x.l_age from
              (select inst, s_open, k, base, max(h_at) as h_at, max(l_at) as l_at, max(h_age) as h_age, max(l_age) as l_age from counted group by inst, s_open, k, base) x join m4 t on t.inst = x.inst and t.open_ns = x.h_at join m4 u on u.inst = x.inst and u.open_ns = x.l_at),
    now as (select g.generation, c.* from gens g join counted c on c.inst = g.inst and c.open_ns = g.open_ns),
    levels as (
        select inst, generation, {_ID} + inst * 4294967296 + base + 1 as level_id, rh as lower, rh as upper, rh as price, {_rotated("s_open", 17, "1")} as group_id, 2 as side, 1 as family, h_age as age, 'developing' as state from now
        union all select inst, generation, {_ID} + inst * 4294967296 + base + 2, rl, rl, rl, {_rotated("s_open", 17, "1")}, -1, 1, l_age, 'developing' from now
        union all select n.inst, generation, {_ID} + n.inst * 4294967296 + base + 3, greatest(t.o, t.c), t.h, t.h, 0, 2, 1, h_age, 'developing' from now n join m4 t on t.inst = n.inst and t.open_ns = n.h_at
        union all select n.inst, generation, {_ID} + n.inst * 4294967296 + base + 4, t.l, least(t.o, t.c), t.l, 0, -1, 1, l_age, 'developing' from now n join m4 t on t.inst = n.inst and t.open_ns = n.l_at
        union all select n.inst, generation, {_ID} + n.inst * 4294967296 + base - 1, s.hi, s.hi, s.hi, {_rotated("s.s_open", 17, "2")}, 2, 1, 0, 'developing' from now n join ses s on s.inst = n.inst and s.k = n.k - 1
        union all select n.inst, generation, {_ID} + n.inst * 4294967296 + base, s.lo, s.lo, s.lo, {_rotated("s.s_open", 17, "2")}, -1, 1, 0, 'developing' from now n join ses s on s.inst = n.inst and s.k = n.k - 1
        union all select n.inst, generation, {_ID} + n.inst * 4294967296 + b.base + 3, greatest(ho, hc), hh, hh, 0, 2, 1, b.h_age, 'frozen' from now n join bands b on b.inst = n.inst and b.k between n.k - 5 and n.k - 1
        union all select n.inst, generation, {_ID} + n.inst * 4294967296 + b.base + 4, ll, least(lo_, lc), ll, 0, -1, 1, b.l_age, 'frozen' from now n join bands b on b.inst = n.inst and b.k between n.k - 5 and n.k - 1
        union all select n.inst, generation, 2 * {_ID} + n.inst * 4294967296 + 3 * (q.m - 1) + v.i, x, x, x, {_rotated("n.s_open", 21, "1200000000000")}, v.side, 2, r_age, case when open_ns >= form_end then 'frozen' else 'developing' end
            from now n join (select inst, s_open, row_number() over (partition by inst order by s_open) as m from ses where first_ns < s_open + 1200000000000) q on q.inst = n.inst and q.s_open = n.s_open
            cross join lateral (select unnest([1, 2, 3]) as i, unnest([2, -1, 1]) as side, unnest([r_hi, r_lo, r_lo + (r_hi - r_lo) // 2]) as x) v
        union all select g.inst, g.generation, 3 * {_ID} + g.inst * 4294967296 + a.i + 1, a.price, a.price, a.price, {_rotated("e.epoch", 29, "20")}, case a.i when 0 then -1 when 7 then 2 else 0 end, 3, p_age, 'developing'
            from gens g join aged a on a.inst = g.inst and a.open_ns = g.open_ns join (select inst, min(open_ns) as epoch from m4 group by inst) e on e.inst = g.inst)"""
_CLUSTER = "STRUCT(low BIGINT, high BIGINT, center BIGINT, grps BIGINT[], sides INTEGER[], members BIGINT[])"
_NODE = "STRUCT(center BIGINT, low BIGINT, high BIGINT, node BIGINT, sides INTEGER[], members BIGINT[], created_ns BIGINT, rel BIGINT[])"
_FITS = """(greatest(c.low - x.upper, x.lower - c.high, 0) <= th and not (x.grp <> 0 and list_contains(c.grps, x.grp)) and not ((x.side = -1 and list_contains(c.sides, 2)) or (x.side = 2 and list_contains(c.sides, -1))))"""
_PICK = f"coalesce(list_max(list_transform(acc, lambda c, i: case when {_FITS} then i else 0 end)), 0)"
_RELATED = "(len(list_intersect(x.members, p.members)) > 0 or (greatest(x.low - p.high, p.low - x.high, 0) <= th and not ((list_contains(p.sides, 2) and list_contains(x.sides, -1)) or (list_contains(p.sides, -1) and list_contains(x.sides, 2)))))"
#: The clusters of every generation, by a fold over its levels in order, and the nodes they continue, by a walk over the generations.
WALK = ACTIVE + f"""
    , ranged as (select inst, open_ns, greatest(h - l, abs(h - coalesce(pc, h)), abs(l - coalesce(pc, l))) as tr from (select inst, open_ns, h, l, lag(c) over (partition by inst order by open_ns) as pc from m4) z),
    atrs as (select inst, open_ns, cast(trunc(sum(tr) over w / count(*) over w) as bigint) as atr from ranged window w as (partition by inst order by open_ns rows between 13 preceding and current row)),
    per as (select g.inst, g.generation, g.open_ns as bar_ns, m.close_ns as at_ns, a.atr, cast(greatest(a.atr * 80000 // 1000000, 2) as bigint) as th from gens g join m4 m on m.inst = g.inst and m.open_ns = g.open_ns join atrs a on a.inst = g.inst and a.open_ns = g.open_ns),
    listed as (select inst, generation, list({{'lower': cast(lower as bigint), 'upper': cast(upper as bigint), 'price': cast(price as bigint), 'level_id': cast(level_id as bigint), 'grp': cast(group_id as bigint), 'side': cast(side as integer)}} order by lower, upper, price, level_id) as ls from levels group by inst, generation),
    clustered as (select p.*, list_sort(list_transform(list_reduce(ls, lambda acc, x: case when {_PICK} = 0 then list_append(acc, {{'low': x.lower, 'high': x.upper, 'center': x.price, 'grps': [x.grp], 'sides': [x.side], 'members': [x.level_id]}})
        else list_transform(acc, lambda c, i: case when i = {_PICK} then {{'low': least(c.low, x.lower), 'high': greatest(c.high, x.upper), 'center': least(c.low, x.lower) + (greatest(c.high, x.upper) - least(c.low, x.lower)) // 2, 'grps': list_append(c.grps, x.grp), 'sides': list_append(c.sides, x.side), 'members': list_append(c.members, x.level_id)}} else c end) end,
        cast([] as {_CLUSTER}[])), lambda c, i: {{'center': c.center, 'low': c.low, 'high': c.high, 'made': i, 'sides': list_sort(list_distinct(c.sides)), 'members': list_sort(c.members)}})) as cs from per p join listed l on l.inst = p.inst and l.generation = p.generation),
    walk as (with recursive steps as (
        select inst, cast(0 as bigint) as generation, cast(0 as bigint) as bar_ns, cast(0 as bigint) as at_ns, cast(0 as bigint) as atr, cast([] as {_NODE}[]) as before, cast([] as {_NODE}[]) as nodes, cast(1 as bigint) as number from (select distinct inst from clustered) d
        union all
        select inst, generation, bar_ns, at_ns, atr, before, list_sort(made.out), made.number from (
            select c.inst, c.generation, c.bar_ns, c.at_ns, c.atr, s.nodes as before, list_reduce(c.cs, lambda acc, x: list_transform([
                list_sort(list_transform(list_filter(s.nodes, lambda p: {_RELATED.replace("th", "c.th")} and not list_contains(acc.used, p.node)), lambda p: {{'s': -len(list_intersect(x.members, p.members)), 'd': abs(x.center - p.center), 'node': p.node, 'created': p.created_ns}}))[1]],
                lambda b: {{'used': case when b.node is null then acc.used else list_append(acc.used, b.node) end, 'number': acc.number + case when b.node is null then 1 else 0 end,
                  'out': list_append(acc.out, {{'center': x.center, 'low': x.low, 'high': x.high, 'node': coalesce(b.node, c.inst * 4294967296 + acc.number), 'sides': x.sides, 'members': x.members, 'created_ns': coalesce(b.created, c.at_ns),
                    'rel': list_transform(list_filter(s.nodes, lambda p: {_RELATED.replace("th", "c.th")}), lambda p: p.node)}})}})[1],
                {{'used': cast([] as bigint[]), 'number': s.number, 'out': cast([] as {_NODE}[])}}) as made
            from steps s join clustered c on c.inst = s.inst and c.generation = s.generation + 1) m)
        select * from steps where generation > 0),
    each_node as (select inst, generation, bar_ns, at_ns, atr, before, n.* from (select *, unnest(nodes) as n from walk) u)"""
_TEXT = "array_to_string({}, ',')"
_FIELDS = ("level_id", "lower", "upper", "price", "group_id", "side", "family", "age", "state")
_LINE = " || ".join(f"length(cast({c} as varchar)) || ':' || {c} || ';'" for c in _FIELDS)

#: What a mutation breaks, given kind, family and side (b) of the one before; null for nothing.
_BROKEN = """[case when x.level_id = 0 then 'missing identity' end, case when x.kind = 'created' and b.kind is not null then 'duplicate identity' end, case when x.kind <> 'created' and b.kind is null then 'unknown identity' end,
    case when (x.kind in ('updated', 'frozen') and b.kind in ('expired', 'superseded', 'frozen')) or (x.kind in ('expired', 'superseded') and b.kind in ('expired', 'superseded')) then 'immutable identity' end,
    case when x.kind = 'updated' and (x.family <> b.family or x.side <> b.side) then 'identity drift' end, case when x.kind in ('created', 'updated') and not (x.lower <= x.price and x.price <= x.upper) then 'geometry' end]"""
_STATE = "STRUCT(kind VARCHAR, family INTEGER, side INTEGER)"
_OPERATOR = "('operator_note', 'intervention', 'review', 'amendment', 'redaction')"
ORACLES = {
    "structure_nodes": WALK + f" select inst, generation, at_ns, node, low, high, center, {_TEXT.format('sides')} as sides, {_TEXT.format('members')} as members, {_TEXT.format('list_sort(list_distinct(list_transform(members, lambda m: m >> 48)))')} as families, created_ns, at_ns as updated_ns from each_node",
    "node_genealogy": WALK + """
        , born as (select inst, generation, bar_ns, case when len(rel) = 0 then 'created' when len(rel) > 1 then 'merged' else 'preserved' end as event, node, case when len(rel) > 1 then array_to_string(list_sort(list_filter(rel, lambda r: r <> node)), ',') else '' end as others from each_node),
        old as (select inst, generation, bar_ns, nodes, unnest(before) as p from walk),
        gone as (select inst, generation, bar_ns, p.node as node, list_transform(list_filter(nodes, lambda n: list_contains(n.rel, p.node)), lambda n: n.node) as heirs from old)
        select inst, generation, bar_ns, event, node, others from born union all
        select inst, generation, bar_ns, case when len(heirs) = 0 then 'expired' else 'split' end, node, array_to_string(list_sort(heirs), ',') from gone where len(heirs) <> 1""",
    "node_corridors": WALK + """
        , ordered as (select *, lead(node) over w as upper_node, lead(low) over w as upper_low from each_node window w as (partition by inst, generation order by center, low, high, node))
        select inst, generation, node as lower_node, upper_node, high as lower_edge, upper_low as upper_edge, greatest(upper_low - high, 0) as width, case when atr > 0 then greatest(upper_low - high, 0) * 1000000 // atr else 0 end as width_ppm from ordered where upper_node is not null""",
    "price_in_structure": WALK + """
        , marks as (select inst, generation, at_ns, nodes, lead(at_ns, 1, 9000000000000000000) over (partition by inst order by generation) as next_ns from walk),
        met as (select t.seq, t.inst, t.ts_ns, t.px, m.generation, m.nodes from ticks t left join marks m on m.inst = t.inst and t.ts_ns >= m.at_ns and t.ts_ns < m.next_ns),
        found as (select *, list_sort(list_transform(list_filter(nodes, lambda n: px between n.low and n.high), lambda n: {'w': n.high - n.low, 'node': n.node, 'low': n.low, 'high': n.high}))[1] as i, list_filter(nodes, lambda n: n.center < px)[-1] as u, list_filter(nodes, lambda n: n.center >= px)[1] as o from met)
        select seq, inst, ts_ns, px, generation as asof_generation, case when coalesce(len(nodes), 0) = 0 then 'unavailable' when i is not null then 'inside' when u is null then 'below' when o is null then 'above' else 'between' end as place, coalesce(i.node, u.node) as lower_node, coalesce(i.node, o.node) as upper_node,
        case when i is not null then px - i.low when u is not null then greatest(px - u.high, 0) end as to_lower, case when i is not null then i.high - px when o is not null then greatest(o.low - px, 0) end as to_upper from found""",
    "book_violations": f"""
        , judged as (select inst, generation, level_id, unnest({_BROKEN}) as rule from (select x, inst, generation, level_id, lag({{'kind': kind, 'family': family, 'side': side}}) over (partition by inst, level_id order by generation, ordinal) as b from
          (select l as x, l.* from book_log l) y) z)
        select inst, generation, level_id, rule from judged where rule is not null""",
    # A walk over the generations that carries the state of all levels; a refused one leaves it as it was.
    "book_replay": f"""
        , listed as (select inst, generation, list(l order by ordinal) as xs from book_log l group by inst, generation),
        walk as (with recursive steps as (
            select distinct inst, cast(0 as bigint) as generation, cast(map() as MAP(BIGINT, {_STATE})) as book, true as ok from listed
            union all
            select inst, generation, case when made.ok then made.book else book end, made.ok from (
                select l.inst, l.generation, s.book, list_reduce(l.xs, lambda acc, x: list_transform([{{'b': acc.book[x.level_id]}}], lambda t: {{'ok': acc.ok and list_bool_and(list_transform({_BROKEN.replace("b.", "t.b.")}, lambda r: r is null)),
                    'book': map_concat(acc.book, map([x.level_id], [{{'kind': x.kind, 'family': x.family, 'side': x.side}}]))}})[1], {{'ok': true, 'book': s.book}}) as made
                from steps s join listed l on l.inst = s.inst and l.generation = s.generation + 1) m)
            select inst, generation from steps where ok)
        select l.inst, l.generation, ordinal, kind, level_id, lower, upper, price from book_log l join walk w on l.inst = w.inst and l.generation = w.generation""",
    "structure_fingerprint": ACTIVE + f" select inst, generation, count(*) as n, sha256('levels/1' || chr(10) || count(*) || chr(10) || string_agg({_LINE}, chr(10) order by price, level_id)) as fingerprint from levels group by inst, generation",
    # A mutation changes a value, the age or the state, so a version is a stretch of generations in which nothing changes.
    "structure_levels": ACTIVE + """
        , newest as (select inst, max(generation) as newest from gens group by inst)
        select l.inst, min(generation) as from_generation, level_id, lower, upper, price, group_id, side, family, cast(age as bigint) as age, case when max(generation) < any_value(newest) then max(generation) + 1 end as to_generation, state
        from levels l join newest w on w.inst = l.inst group by l.inst, level_id, lower, upper, price, group_id, side, family, age, state""",
    "chart_structure": ACTIVE + """
        , ranked as (select *, case when family = 1 and level_id % 4294967296 <= 4 then level_id % 4294967296 - 1 when family = 1 then (level_id % 4294967296 - 3) % 6 when family = 2 then (level_id % 4294967296 - 1) % 3 else level_id % 4294967296 - 1 end as r,
          family = 1 and (case when level_id % 4294967296 <= 4 then level_id % 4294967296 - 1 else (level_id % 4294967296 - 5) % 6 - 2 end) in (2, 3) as is_band from levels where generation % 50 = 0),
        named as (select *, case when family = 3 then 'R' || r when family = 2 then ['ORH', 'ORL', 'ORM'][r + 1] when level_id % 4294967296 <= 4 then ['CSH', 'CSL', 'D-U', 'D-L'][r + 1]
          else ['PSH', 'PSL', 'CSH', 'CSL', 'D-U', 'D-L'][(level_id % 4294967296 - 5) % 6 + 1] end as label, case family when 3 then 4 else 3 end as priority from ranked)
        select inst, generation, case when is_band then 'band' else 'line' end as shape, row_number() over (partition by inst, generation, is_band order by priority, lower, level_id) as place, level_id, lower, upper, label,
        case family when 3 then 'range' else 'boundary' end as style, priority, state = 'frozen' as frozen from named""",
    "draft_validity": f"""
        select d.entry_id, case when d.source_key = 0 then 'missing source key' when d.actor_id = 0 or d.schema_version = 0 then 'missing identity' when d.received_ns < d.event_ns or d.recorded_ns < d.received_ns then 'time order'
        when d.first_sequence = 0 or d.last_sequence < d.first_sequence then 'canonical range' when d.kind in {_OPERATOR} and d.actor_kind = 'machine' then 'actor kind' when d.kind in {_OPERATOR} and d.body = '' then 'missing body'
        when d.kind in ('amendment', 'redaction') and d.parent_id = 0 then 'missing parent' when d.parent_id <> 0 and p.entry_id is null then 'unknown parent' when d.parent_id <> 0 and p.case_id <> d.case_id then 'parent of another case' end as problem
        from drafts d left join drafts p on d.parent_id = p.entry_id""",
    "automatic_validity": f"""
        select entry_id, case when source_key = 0 then 'missing source key' when actor_id = 0 then 'missing actor' when (actor_kind = 'operator' and entry_id % 8 = 0) or kind in {_OPERATOR} then 'operator authority' when length(body) = 0 then 'missing body'
        when received_ns < event_ns then 'time order' when schema_version = 0 then 'missing schema version' when first_sequence = 0 or last_sequence < first_sequence then 'canonical range'
        when policy = 'none' and kind in ('intent', 'order', 'fill', 'position', 'exit') then 'case required' when policy = 'existing' and case_id % 13 = 0 then 'missing case' when policy = 'correlate' and correlation % 17 = 0 then 'missing correlation' end as problem from drafts""",
    "operator_validity": """
        select d.entry_id, case when d.source_key = 0 then 'missing key' when trim(d.body) = '' then 'missing body' when d.entry_id % 71 = 0 then 'time' when d.kind in ('intervention', 'review') and d.case_id % 13 = 0 then 'case required'
        when d.entry_id % 4 in (0, 1) and (d.case_id % 13 = 0 or d.parent_id = 0) then 'case and parent required' when d.parent_id <> 0 and p.entry_id is null then 'unknown parent' when d.parent_id <> 0 and p.actor_kind <> 'operator' then 'machine evidence' end as problem
        from drafts d left join drafts p on d.parent_id = p.entry_id""",
    "case_assignment": """
        , firsts as (select correlation, min(entry_id) as first_at, arg_min(policy, entry_id) as how, arg_min(case_id, entry_id) as asked from drafts where policy <> 'none' and correlation <> 0 group by correlation),
        opened as (select correlation, 999999 + row_number() over (order by first_at) as fresh from firsts where correlation % 4 <> 1 and how = 'correlate'),
        cases as (select f.correlation, case when f.correlation % 4 = 1 then f.correlation + 500000 when how = 'existing' then asked else fresh end as c from firsts f left join opened o on f.correlation = o.correlation)
        select entry_id as ordinal, cast(case policy when 'none' then 0 when 'existing' then case when c is null or c = case_id then case_id end else c end as bigint) as assigned, coalesce(policy = 'existing' and c <> case_id, false) as conflict
        from drafts d left join cases s on d.correlation = s.correlation""",
    "ledger_bodies": "select doc_id as entry_id, case when doc_id % 19 = 0 then 'no body' when doc_id % 23 = 0 then 'length' when doc_id % 29 = 0 then 'digest' end as problem, case when doc_id % 19 <> 0 and doc_id % 23 <> 0 and doc_id % 29 <> 0 then length(text) end as n_chars from documents",
    "ledger_views": """
        , pages as (select 'lifecycle' as view, kind, entry_id from drafts union all select 'decisions', kind, entry_id from drafts where kind in ('decision', 'risk') union all select 'orders', kind, entry_id from drafts where kind in ('intent', 'order')
        union all select 'fills', kind, entry_id from drafts where kind = 'fill' union all select 'positions', kind, entry_id from drafts where kind in ('position', 'exit') union all select 'reconciliation', kind, entry_id from drafts where kind = 'reconciliation'
        union all select 'incidents', kind, entry_id from drafts where kind in ('incident', 'operator_note'))
        select view, kind, count(*) as n, max(entry_id) as newest from pages group by view, kind""",
    "incident_timeline": "select entry_id, kind, status, event_ns from (select * from drafts order by entry_id desc limit 256) v where kind = 'incident' or status = 'incident' order by entry_id desc limit 8",
    "top_decisions": "select entry_id, kind, event_ns from (select * from drafts order by entry_id desc limit 256) v where kind in ('decision', 'risk') order by entry_id desc limit 3",
}
#: A stream in turns gives what the whole history does.
ORACLES |= {"streamed_structure_levels": ORACLES["structure_levels"], "streamed_structure_nodes": ORACLES["structure_nodes"], "streamed_price_places": ORACLES["price_in_structure"]}
