import json

from quayside.operators import joins
from quayside.sources import decoders
from quayside.streaming import bars

M = bars.MINUTE


def test_interval_join(spark):
    spans = spark.createDataFrame([(1, 0, 25, "a"), (1, 25, 60, "b"), (2, 10, 20, "c"), (2, 30, 30, "empty")], "k long, f long, t long, name string")
    events = spark.createDataFrame([(1, 0), (1, 24), (1, 25), (1, 60), (2, 9), (2, 19), (3, 5), (1, None)], "k long, at long")
    got = joins.interval_join(events, spans, on=["k"], at="at", start="f", end="t", cell=10).collect()
    assert sorted((r.k, r.at, r.name) for r in got) == [(1, 0, "a"), (1, 24, "a"), (1, 25, "b"), (2, 19, "c")]
    kept = joins.interval_join(events, spans, on=["k"], at="at", start="f", end="t", cell=7, how="left")
    assert kept.count() == 8
    assert joins.overlaps(spans, on=["k"], start="f", end="t").count() == 0


def test_asof_join(spark):
    left = spark.createDataFrame([("x", 1), ("x", 5), ("x", 9), ("x", 40), ("y", 3), ("x", None)], "k string, at long")
    right = spark.createDataFrame([("x", 2, 20), ("x", 5, 50), ("x", 8, None), ("z", 0, 1), ("x", None, 7)], "k string, t long, v long")
    for cell in (1, 4, 1000):
        got = {(r.k, r.at): (r.asof_v, r.asof_t) for r in joins.asof_join(left, right, on=["k"], left_at="at", right_at="t", take=["v", "t"], cell=cell).collect()}
        assert got == {("x", 1): (None, None), ("x", 5): (50, 5), ("x", 9): (None, 8), ("x", 40): (None, 8), ("y", 3): (None, None), ("x", None): (None, None)}
    assert [r.k for r in joins.missing(left.select("k").distinct(), right, ["k"]).collect()] == ["y"]


def receipts(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "receipt_id long, payload string")


def test_decoders(spark):
    point = lambda y, p, v, *f: {"year": y, "period": p, "value": v, "footnotes": [{"code": c} for c in f]}
    labour = receipts(spark, {"Results": {"series": [{"seriesID": "S", "data": [point("2024", "M02", "3.5", "P"), point("2024", "M01", "-"), point("2023", "M13", "9"), point("2023", "M12", "3.25")]}]}}, "not json")
    got = decoders.labour_series(labour)
    assert sorted((str(r.period_start), r.value, r.provisional) for r in got.collect()) == [("2023-12-01", 3.25, False), ("2024-02-01", 3.5, True)]
    assert [r.receipt_id for r in decoders.undecoded(labour, got).collect()] == [1]
    rates = decoders.daily_rates(receipts(spark, *[{"units": u, "output_type": 1, "observations": [{"date": "2024-01-02", "value": v}, {"date": "2024-01-03", "value": "."}]} for u, v in (("lin", "4.1"), ("lin", "oops"), ("pch", "4.1"))], {"units": "lin", "output_type": 1, "observations": [{"date": "2024-01-02", "value": "1"}] * 2}), "R").collect()
    assert [(r.receipt_id, str(r.period_start), r.value) for r in rates] == [(0, "2024-01-02", 4.1)]
    data = [{"TableName": "T", "LineNumber": n, "TimePeriod": p, "DataValue": v} for n, p, v in (("1", "2024Q2", "1,234.5"), ("1", "2024M11", "2"), ("2", "2024Q1", "3"))]
    accounts = decoders.national_accounts(receipts(spark, {"BEAAPI": {"Results": {"Data": data}}}), "T", "1").collect()
    assert sorted((str(r.period_start), r.value) for r in accounts) == [("2024-04-01", 1234.5), ("2024-11-01", 2.0)]
    cube = {"version": "2.0", "class": "dataset", "id": ["geo", "time"], "size": [1, 3], "dimension": {"time": {"category": {"index": {"2024-01": 0, "2024-02": 1, "2024-Q3": 2}}}}, "value": {"0": 1.5, "2": 2.5}, "status": {"2": "p"}}
    assert sorted((str(r.period_start), r.value, r.provisional) for r in decoders.stat_cube(receipts(spark, cube, cube | {"size": [2, 3]}, cube | {"version": "1.0"}), "C").collect()) == [("2024-01-01", 1.5, False), ("2024-07-01", 2.5, True)]
    sets = {"STATUS": 200, "NEXTPOSITION": None, "RESULTSET": [{"SERIES_CODE": "A", "VALUES": {"SURVEY_DATES": [20240105, 20240106], "VALUES": [0.5, None]}}, {"SERIES_CODE": "B", "VALUES": {"SURVEY_DATES": [202403], "VALUES": [22]}}]}
    assert sorted((r.series, str(r.period_start), r.value) for r in decoders.parallel_arrays(receipts(spark, sets, sets | {"NEXTPOSITION": 3}, sets | {"RESULTSET": [{"SERIES_CODE": "A", "VALUES": {"SURVEY_DATES": [20240230], "VALUES": [1]}}]})).collect()) == [("A", "2024-01-05", 0.5), ("B", "2024-07-01", 22.0)]
    ohlc = {"ticker": "I:X", "resultsCount": 1, "results": [{"o": 1.25, "h": 1.5, "l": 1.0, "c": 1.25, "t": 60000}]}
    assert [tuple(r)[1:] for r in decoders.aggregate_bars(receipts(spark, ohlc, ohlc | {"resultsCount": 2}, {"ticker": "I:X", "resultsCount": 2, "results": ohlc["results"] * 2}), 100).collect()] == [("I:X", 60_000_000_000, 125, 150, 100, 125)]


def test_streamed_bars_correct_late_ticks(spark, tmp_path):
    tick = lambda seq, minute, px: (1, seq, minute * M, px, 0, 60 * M)
    batches = [[tick(1, 1, 100), tick(2, 3, 98), tick(3, 4, 110)], [tick(4, 2, 105)], [tick(5, 9, 90)], [tick(6, 25, 95)]]
    source, names = tmp_path / "in", "inst long, seq long, ts_ns long, px long, s_open long, s_close long"
    for rows in batches:
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(str(source))
        bars.stream_bars(spark.readStream.schema(names).parquet(str(source)), str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema(bars.EMITTED).parquet(str(tmp_path / "out/emitted")).orderBy("batch", "minutes", "open_ns").collect()
    assert [(r.batch, r.minutes, r.open_ns // M, r.o, r.h, r.l, r.c, r.n, r.revision, r.correction) for r in got] == [
        (0, 4, 0, 100, 100, 98, 98, 2, 0, False),
        (2, 4, 0, 100, 105, 98, 98, 3, 1, True),
        (2, 4, 4, 110, 110, 110, 110, 1, 0, False),
        (3, 4, 8, 90, 90, 90, 90, 1, 0, False),
        (3, 20, 0, 100, 110, 90, 90, 5, 0, False),
    ]
