"""Upserts into stored series against a dictionary, their failures, and the plan of the stored side."""

import random

import pytest

from quayside.sources import series_store as store

COLUMNS = f"{store.BAR}, version bigint"


def test_upserts_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SLICE", 20)  # several slices an upsert
    rng, held, folder = random.Random(1), {}, str(tmp_path)
    for number in range(1, 4):
        rows = [(rng.randint(1, 2), 4, rng.randint(0, 5) * store.DAY + 240 * rng.randint(0, 9), 1, 5, 9, 1, rng.randint(1, 2), 3, v) for v in range(60)]
        want = {}
        for r in sorted(rows, key=lambda r: r[-1]):
            want[r[:3]] = r[3:-1]
        kinds = {k: "insert" if k not in held else "none" if held[k] == v else "replace" for k, v in want.items()}
        changes = store.upsert(spark, folder, spark.createDataFrame(rows, COLUMNS))
        assert {(r.inst, r.minutes, r.open_ns): r.kind for r in changes.collect()} == kinds and changes.count() == len(kinds)
        held |= want
        assert {tuple(r)[:3]: tuple(r)[3:] for r in store.bars(spark, folder).collect()} == held
        if number == 1:
            first = dict(held)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in store.bars(spark, folder, number=1).collect()} == first


def test_a_failed_upsert_leaves_the_store(spark, tmp_path, monkeypatch):
    folder, row = str(tmp_path), (1, 4, 0, 1, 5, 9, 1, 7, 3, 1)
    store.upsert(spark, folder, spark.createDataFrame([row, (1, 4, 9 * store.DAY, 1, 5, 9, 1, 7, 3, 1)], COLUMNS))
    real = store.commit
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(spark, folder, spark.createDataFrame([(*row[:7], 8, *row[8:])], COLUMNS))
    assert {r.c for r in store.bars(spark, folder).collect()} == {7} and store.catalogue(spark, folder)["number"] == 1
    monkeypatch.setattr(store, "commit", real)
    store.upsert(spark, folder, spark.createDataFrame([(*row[:7], 8, *row[8:])], COLUMNS))
    assert sorted(r.c for r in store.bars(spark, folder).collect()) == [7, 8]
    assert store.catalogue(spark, folder)["days"] == {"0": 2, "9": 1}  # the untouched day was not written again
    plan = store._judged(store.bars(spark, folder), spark.createDataFrame([row], COLUMNS))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
