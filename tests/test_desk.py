"""Operators of the desk, the ledger, control and sequences on small cases whose results are written down."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import control, journal, ledger, levels, macro, market, sequences

ROWS = "k long, cell long, at long, v long"


def test_running_values_against_plain_loops(spark):
    rng = random.Random(5)
    rows = [(k, at // 7, at, rng.choice([None, rng.randint(0, 99)])) for k in range(3) for at in sorted(rng.sample(range(100), 40))]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    best = sequences.running_max(df, on=["k"], cell="cell", order=["at"], value=F.col("v"), into="m")
    last = sequences.running_last(best, on=["k"], cell="cell", order=["at"], value=F.col("v"), into="p")
    got = {(r.k, r.at): (r.m, r.p) for r in last.collect()}
    for k, _, at, _ in rows:
        before = [v for kk, _, a, v in rows if kk == k and a < at and v is not None]
        assert got[k, at] == (max(before, default=None), before[-1] if before else None)
    ranked = {(r.k, r.at): (r.n, r.own) for r in sequences.running_rank(sequences.running_rank(df, cell="cell", order=["cell", "at", "k"], into="n"), on=("k",), cell="cell", order=["at"], into="own").collect()}
    order = sorted((c, at, k) for k, c, at, _ in rows)
    assert all(ranked[k, at][0] == i + 1 for i, (_, at, k) in enumerate(order))
    assert all(ranked[k, at][1] == 1 + sum(kk == k and a < at for kk, _, a, _ in rows) for k, _, at, _ in rows)
    for n in (1, 3, 9):
        w = sequences.with_lead_in(df, on=["k"], cell="cell", order="at", n=n)
        reach = {(r.k, r.cell): sorted(r.ats) for r in w.where("lead_in").groupBy("k", "cell").agg(F.collect_list("at").alias("ats")).collect()}
        for k, c, _, _ in rows:
            own = [a for kk, cc, a, _ in rows if kk == k and cc == c]
            want = [a for kk, _, a, _ in rows if kk == k and a < min(own)][-n:]
            assert reach.get((k, c), []) == want, (n, k, c)


def test_modes_of_the_core(spark):
    fine = dict.fromkeys(control.CONDITIONS, True)
    steps = [("mode", "live", {}), ("health", None, {}), ("arm", None, {}), ("agreement", None, {"contracts_agree": False}), ("agreement", None, {}), ("arm", None, {"clock_synchronized": None}), ("arm", None, {}), ("health", None, {"data_fresh": False}), ("mode", "shadow", {}), ("halt", None, {}), ("arm", None, {})]
    rows = [(1, i // 3, i, c, m, *(fine | x).values()) for i, (c, m, x) in enumerate(steps)]
    df = spark.createDataFrame(rows, "desk long, day long, seq long, command string, mode string, " + ", ".join(f"{c} boolean" for c in control.CONDITIONS))
    got = control.modes(df, on=["desk"], cell="day", order="seq").orderBy("seq").collect()
    assert [r.after for r in got] == ["disconnected", "read_only", "live", "read_only", "read_only", "read_only", "live", "read_only", "shadow", "halted", "live"]
    assert got[2].route == "transmit" and got[8].route == "shadow only" and got[9].route == "refused: halted" and got[5].reasons == ["clock unsynchronized"]


def test_cases_are_assigned_once(spark):
    rows = [(1, "correlate", 0, 50), (2, "none", 0, 50), (3, "existing", 7, 50), (4, "existing", 9, 60), (5, "correlate", 0, 60), (6, "correlate", 0, 70), (7, "correlate", 0, 80), (8, "existing", 4, 0)]
    df = spark.createDataFrame([(*r, r[0] // 3) for r in rows], "ordinal long, policy string, case_id long, correlation long, day long")
    known = spark.createDataFrame([(80, 3)], "correlation long, case_id long")
    got = {r.ordinal: (r.assigned, r.conflict) for r in ledger.assign_cases(df, known, 100, cell="day").collect()}
    assert got == {1: (100, False), 2: (0, False), 3: (None, True), 4: (9, False), 5: (9, False), 6: (101, False), 7: (3, False), 8: (4, False)}


def test_bodies_must_be_those_of_their_headers(spark):
    headers = spark.createDataFrame([(1, 1, 3, "x"), (2, 2, 9, ""), (3, 9, 1, ""), (4, 1, 3, "")], "entry_id long, body_id long, body_len int, body_digest string").withColumn("body_digest", F.when(F.col("body_digest") == "", F.md5(F.lit("abc"))).otherwise(F.col("body_digest")))
    bodies = spark.createDataFrame([(1, "abc"), (2, "abc")], "body_id long, body string")
    assert {r.entry_id: (r.problem, r.body) for r in ledger.with_bodies(headers, bodies).collect()} == {1: ("digest", None), 2: ("length", None), 3: ("no body", None), 4: (None, "abc")}


def test_the_office_stops_at_a_sequence_that_does_not_rise(spark):
    rows = [(1, i, s, k, i // 2) for i, (s, k) in enumerate([(1, "observation"), (2, "quote"), (3, "document"), (3, "release"), (9, "observation")])] + [(2, 0, 5, "positioning", 0)]
    df = spark.createDataFrame(rows, "office long, ordinal long, sequence long, kind string, day long").withColumns({c: F.col("ordinal") for c in ("receipt", "source", "stream", "received_ns")})
    got = {r.office: r for r in macro.project(df, on=["office"], cell="day", order="ordinal").collect()}
    assert (got[1].events, got[1].data_events, got[1].documents, got[1].last_sequence, got[1].stopped_at) == (2, 1, 1, 3, 3)
    assert (got[2].events, got[2].stopped_at) == (1, None)


def test_the_book_is_replayed_without_refused_generations(spark):
    row = lambda g, kind, lid, low=1, up=3: (1, g, g, kind, lid, low, up, 2, 0, 2, 1)
    log = [row(1, "created", 5), row(2, "updated", 5, 3, 1), row(2, "created", 6), row(3, "updated", 6), row(4, "frozen", 5), row(5, "updated", 5), row(6, "expired", 5)]
    df = spark.createDataFrame(log, "inst long, generation long, ordinal long, kind string, level_id long, lower long, upper long, price long, group_id long, side int, family int")
    assert sorted((r.generation, r.kind) for r in levels.applied(df).collect()) == [(1, "created"), (4, "frozen"), (6, "expired")]
    assert levels.applied(df.limit(0)).isEmpty()


def test_manifests_with_a_problem_are_not_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "open", 1, 5), ("b", 1, "personal", 1, 5)], "dataset string, source long, license string, start_ns long, end_ns long")
    found = journal.manifest(df, "redistribution")
    with pytest.raises(ValueError):
        journal.write_manifest(found, f"{tmp_path}/m")
    journal.write_manifest(found.where("dataset = 'a'"), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 1


def test_a_reference_value_is_only_replaced_by_what_is_not_older(spark):
    rows = [(1, 1, "bar", 50, 10), (1, 2, "bar", 40, 11), (1, 3, "index", 30, 12), (1, 4, "bar", 29, 13), (1, 5, "bar", 31, 14), (1, 6, "bar", 30, 15), (2, 1, "index", 9, 1), (2, 2, "index", 3, 2), (3, 1, "bar", 3, 7), (3, 2, "bar", 3, 8)]
    df = spark.createDataFrame(rows, "inst long, sequence long, kind string, ts_ns long, value long")
    assert {r.inst: (r.value, r.ts_ns) for r in market.reference_values(df).collect()} == {1: (14, 31), 2: (2, 3), 3: (8, 3)}


def test_operators_on_empty_tables(spark):
    ticks = spark.createDataFrame([], "inst long, sequence long, kind string, ts_ns long, value long")
    assert market.reference_values(ticks).isEmpty()
    bars = spark.createDataFrame([], "inst long, s_open long, s_close long, open_ns long, close_ns long, o long, h long, l long, c long")
    assert market.true_ranges(bars).isEmpty() and market.gaps(bars).isEmpty() and market.rolling(bars, 3, x=F.sum("c")).isEmpty()
