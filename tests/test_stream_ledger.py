"""Transactions of the ledger, the office on a stream and the ordered digest, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import journal, macro
from quayside.streaming import ledger, office


def commands(seed, n=120):
    rng, rows = random.Random(seed), []
    for i in range(1, n):
        key = rng.randint(1, 60)
        rows.append((i, key, ("none", "existing", "correlate")[key % 3], key % 7 + 1, key % 5, None, "bad" if i % 17 == 0 else None, i // 8))
    return rows


def book(rows):
    """What a ledger does with commands one by one: (ordinal, outcome, entry, case)."""
    keys, cases, out, case = {}, {}, [], ledger.FIRST_CASE
    for ordinal, key, policy, case_id, correlation, _, problem, _ in rows:
        if key in keys:
            out.append((ordinal, "existing", *keys[key]))
            continue
        known = cases.get(correlation) if correlation and policy != "none" else None
        mine = 0 if policy == "none" else case_id if policy == "existing" else known
        if policy == "correlate" and mine is None and correlation:
            mine = case
        if problem or mine is None or policy == "existing" and known not in (None, case_id):
            out.append((ordinal, "refused", None, None))
            continue
        case += mine == case and policy == "correlate"
        if policy != "none" and correlation:
            cases.setdefault(correlation, mine)
        keys[key] = (len(keys) + 1, mine)
        out.append((ordinal, "appended", *keys[key]))
    return out


def test_batches_equal_one_by_one_and_failures_leave_no_trace(spark, tmp_path, monkeypatch):
    rows, folder = commands(1), str(tmp_path / "ledger")
    frame = spark.createDataFrame(rows, ledger.COMMAND)
    parts = [frame.where(F.col("ordinal").between(a, b)) for a, b in ((1, 40), (41, 80), (81, 200))]
    # A key's repeats within one batch share its outcome; here a bad command is never a key's only chance in its batch.
    ledger.append(spark, folder, parts[0], 0)
    before = sorted(map(tuple, ledger.snapshot(spark, folder).select("entry_id", "ordinal").collect()))
    real = ledger.commit
    monkeypatch.setattr(ledger, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ledger.append(spark, folder, parts[1], 1)
    assert sorted(map(tuple, ledger.snapshot(spark, folder).select("entry_id", "ordinal").collect())) == before and ledger.committed(spark, folder)["number"] == 0
    monkeypatch.setattr(ledger, "commit", real)
    for number, part in ((1, parts[1]), (2, parts[2]), (1, parts[1]), (2, parts[2])):  # the last two are replays
        ledger.append(spark, folder, part, number)
    got = sorted((r.ordinal, r.outcome, r.entry_id, r.assigned) for r in ledger.snapshot(spark, folder, "outcomes").collect())
    assert got == book(rows)
    assert {o for _, o, *_ in got} == {"appended", "existing", "refused"}
    assert sorted(r.entry_id for r in ledger.snapshot(spark, folder).collect()) == list(range(1, sum(o == "appended" for _, o, *_ in got) + 1))


def test_epochs_are_appended_whole(spark, tmp_path):
    rows = [(1, 1, "none", 0, 0, 5, None, 0), (2, 2, "none", 0, 0, 5, "bad", 0), (3, 3, "none", 0, 0, 6, None, 0), (4, 4, "correlate", 0, 9, None, None, 0), (5, 5, "existing", 77, 9, 7, None, 0), (6, 6, "none", 0, 0, 7, None, 0), (7, 1, "none", 0, 0, None, None, 0)]
    ledger.append(spark, str(tmp_path), spark.createDataFrame(rows, ledger.COMMAND), 0)
    got = sorted((r.ordinal, r.outcome) for r in ledger.snapshot(spark, str(tmp_path), "outcomes").collect())
    # Epoch 5 has a problem and epoch 7 a contradicted case; the key of the first command is free again.
    assert got == [(1, "refused"), (2, "refused"), (3, "appended"), (4, "appended"), (5, "refused"), (6, "refused"), (7, "appended")]


def test_office_equals_history_after_each_turn(spark, tmp_path):
    rng, rows, seq = random.Random(2), [], 0
    for i in range(300):
        seq += rng.randint(1, 3)
        fall = i >= 250 and i % 2 == 0 and not any(r[0] == 0 and r[2] < 0 for r in rows)
        rows.append((i % 2, i, seq - 2000 if fall else seq, "release" if fall else rng.choice(["observation", "positioning", "release", "document", "quote"]), i // 3, rng.randint(0, 2), rng.randint(0, 1), 1000 + rng.randint(0, 99), rng.randint(0, 3), rng.randint(0, 30), i, -i))
    frame, folder = spark.createDataFrame(rows, office.INPUT), str(tmp_path)
    for turn, (a, b) in enumerate(((0, 99), (100, 199), (200, 299))):
        frame.where(F.col("ordinal").between(a, b)).write.parquet(f"{folder}/in/{turn}")
        office.stream_office(spark.readStream.schema(office.INPUT).parquet(f"{folder}/in/*"), folder, weeks=4).awaitTermination()
        emitted, so_far = spark.read.parquet(f"{folder}/emitted"), frame.where(F.col("ordinal") <= b)
        want = macro.project(so_far.withColumn("day", F.lit(0)), on=["office"], cell="day", order="ordinal")
        assert sorted(map(tuple, office.latest(emitted).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    stops = {r.office: r.stopped_at for r in want.collect()}
    assert stops[0] is not None and stops[1] is None
    stop = min(r[1] for r in rows if r[0] == 0 and r[2] == stops[0])
    held = {}
    for r in rows:
        if r[3] in ("observation", "positioning") and (r[0] or r[1] < stop):
            held[r[0], r[3], r[8], r[9]] = (r[10], r[11], r[2])
    last = {(o, n): sorted({p for oo, k, nn, p in held if (oo, k, nn) == (o, "positioning", n)})[-4:] for o, k, n, _ in held if k == "positioning"}
    want = sorted((*k, *v) for k, v in held.items() if k[1] == "observation" or k[3] in last[k[0], k[2]])
    assert sorted(map(tuple, office.points(emitted).select("office", "kind", "name", "period", "a", "b", "sequence").collect())) == want


def fold(lines):
    import hashlib

    out = ""
    for i, (prime, base) in enumerate(journal.MODULI):
        h = 0
        for line in lines:
            h = (h * base + int(hashlib.md5(line.encode()).hexdigest()[8 * i : 8 * i + 8], 16)) % prime
        out += f"{h:08x}"
    return out


def test_ordered_digest_is_the_fold_and_joins(spark):
    lines = [f"event {i * i % 77}" for i in range(1500)]
    frame = spark.createDataFrame([(1, i, i // 100, s) for i, s in enumerate(lines)] + [(2, 5, 0, "alone")], "batch long, sequence long, cell long, line string").repartition(7)
    got = {r.batch: (r.n, r.digest) for r in journal.ordered_digest(frame, on=["batch"], cell="cell", order="sequence", line=F.col("line")).collect()}
    assert got == {1: (1500, fold(lines)), 2: (1, fold(["alone"]))}
    assert journal.joined_digest(fold(lines[:400]), fold(lines[400:]), 1100) == fold(lines) != fold(lines[1:] + lines[:1])


def test_intermediate_folders_can_be_removed(spark):
    import os

    from quayside.sources import shared

    mark = shared.written_so_far()
    kept = shared.written(spark.range(3), "forget-one")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and shared.written_so_far() == mark + 1
    shared.forget(spark, mark)
    assert not os.path.exists(path) and shared.written_so_far() == mark
