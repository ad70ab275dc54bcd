"""The macro office on a stream of its events.

State is keyed by office: its counts, the receipts and feeds it has seen, the
latest vintage of every series and period, and each participant's last reports.
An office takes its events in order of their ordinal up to the first whose
sequence does not rise; from then on it stands still and takes nothing more,
also in later micro-batches.  Each micro-batch with events of an office emits one
row: the office as it is now, and the points that changed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quayside.operators.macro import KINDS, WEEKS
from quayside.streaming.keyed import start

#: name and period: series and period of an observation, participant and report date of a positioning report; a and b: its values.
INPUT = "office bigint, ordinal bigint, sequence bigint, kind string, receipt bigint, source bigint, stream bigint, received_ns bigint, name bigint, period bigint, a bigint, b bigint"
TALLY = "events bigint, data_events bigint, documents bigint, releases bigint, receipts bigint, feeds bigint, last_sequence bigint, as_of_ns bigint, stopped_at bigint"
_POINT = "kind:string,name:bigint,period:bigint,a:bigint,b:bigint,sequence:bigint,dropped:boolean"
OUTPUT = f"office bigint, last_ordinal bigint, {TALLY}, points array<struct<{_POINT}>>"
_TALLY = [c.split()[0] for c in TALLY.split(", ")]
_COUNTED = {"observation": "data_events", "positioning": "data_events", "document": "documents", "release": "releases"}


class OfficeProcessor(StatefulProcessor):
    def __init__(self, weeks: int = WEEKS):
        self.weeks = weeks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tally = handle.getValueState("tally", TALLY)
        self.receipts = handle.getMapState("receipts", "receipt bigint", "seen boolean")
        self.feeds = handle.getMapState("feeds", "source bigint, stream bigint", "seen boolean")
        self.points = handle.getMapState("points", "kind string, name bigint, period bigint", "a bigint, b bigint, sequence bigint")
        self.reports = handle.getMapState("reports", "name bigint", "dates array<bigint>")

    def _first(self, seen, key: tuple) -> bool:
        """Whether ``key`` is new; it is not from now on."""
        if seen.containsKey(key):
            return False
        seen.updateValue(key, (True,))
        return True

    def _report(self, name: int, date: int, changed: dict) -> bool:
        """Whether the report is one of the participant's last; the one that it displaces is dropped."""
        dates = list(self.reports.getValue((name,))[0]) if self.reports.containsKey((name,)) else []
        if date in dates:
            return True
        kept = sorted([*dates, date])[-self.weeks :]
        self.reports.updateValue((name,), (kept,))
        for old in set(dates) - set(kept):
            key = ("positioning", name, old)
            a, b, sequence = self.points.getValue(key)
            self.points.removeKey(key)
            changed[key] = (a, b, sequence, True)
        return date in kept

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = dict(zip(_TALLY, self.tally.get(), strict=True)) if self.tally.exists() else dict.fromkeys(_TALLY, 0) | {"stopped_at": None}
        changed, last = {}, None
        for r in sorted((r for r in rows if r.kind in KINDS), key=lambda r: r.ordinal):
            if now["stopped_at"] is not None:
                break
            if (r.sequence or 0) <= now["last_sequence"]:
                now["stopped_at"] = r.sequence
                break
            last = r.ordinal
            now |= {"events": now["events"] + 1, _COUNTED[r.kind]: now[_COUNTED[r.kind]] + 1, "last_sequence": r.sequence, "as_of_ns": max(now["as_of_ns"], r.received_ns)}
            now["receipts"] += self._first(self.receipts, (r.receipt,))
            now["feeds"] += self._first(self.feeds, (r.source, r.stream))
            if r.kind == "observation" or r.kind == "positioning" and self._report(r.name, r.period, changed):
                # The sequence rises, so the event at hand is the latest vintage.
                self.points.updateValue((r.kind, r.name, r.period), (r.a, r.b, r.sequence))
                changed[r.kind, r.name, r.period] = (r.a, r.b, r.sequence, False)
        self.tally.update(tuple(now[f] for f in _TALLY))
        yield Row(office=key[0], last_ordinal=last, **now, points=[(*k, *v) for k, v in changed.items()])

    def close(self) -> None:
        pass


def stream_office(rows: DataFrame, folder: str, *, weeks: int = WEEKS, query_name: str | None = None) -> StreamingQuery:
    """Start the office over what is available of ``rows`` (``INPUT``); emissions (``OUTPUT``) are stored in ``folder``/emitted."""
    return start(rows, "office", OfficeProcessor(weeks), OUTPUT, folder, query_name)


def latest(emitted: DataFrame) -> DataFrame:
    """Each office as its last emission has it."""
    newest = F.struct("events", F.col("stopped_at").isNotNull().alias("stopped"))
    return emitted.groupBy("office").agg(F.max_by(F.struct(*_TALLY), newest).alias("t")).select("office", "t.*")


def points(emitted: DataFrame) -> DataFrame:
    """The points that the offices hold: office, kind, name, period, a, b, sequence."""
    each = emitted.select("office", "events", F.inline("points"))
    nth = F.row_number().over(Window.partitionBy("office", "kind", "name", "period").orderBy(F.desc("events")))
    return each.withColumn("__nth", nth).where((F.col("__nth") == 1) & ~F.col("dropped")).drop("__nth", "dropped", "events")
