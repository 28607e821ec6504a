"""Streams with state of their own: a keyed store, a bounded history, and watches for silence.

State lives in the stream's state store (RocksDB: set spark.sql.streaming.stateStore.providerClass to STORE), so it
survives restarts from the checkpoint and lost executors. Time is that of the events; what has to happen without an
event (expiry, silence) hangs on timers that the watermark fires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WRITES = "owner string, name string, value string, ts timestamp, write_id long"
HISTORY = "series long, nth long, event_id long, ts timestamp, value double"
NOTICES = "series long, notice string, ts timestamp"


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _stamp(millis: int) -> pd.Timestamp:
    return pd.Timestamp(millis, unit="ms")


def _all(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class KeyedStore(StatefulProcessor):
    """The state of an owner: name -> (value, time and number of its last write). What is cleared or too old goes."""

    def __init__(self, keep_millis: int | None):
        self.keep = keep_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "name string", "value string, at long, write_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple] = {}
        for name, value, ts, number in _all(rows, ["ts", "write_id"])[["name", "value", "ts", "write_id"]].itertuples(index=False):
            at = _millis(ts)
            if self.held.containsKey((name,)):
                known = self.held.getValue((name,))
                if (at, number) < (known[1], known[2]):  # a write that comes late doesn't undo a later one
                    continue
            self.held.updateValue((name,), (None if value is None or pd.isna(value) else value, at, int(number)))
            changed[name] = (value, at)
            if self.keep is not None:
                self.handle.registerTimer(at + self.keep)
        out = [(key[0], n, None if v is None or pd.isna(v) else v, _stamp(at), v is None or pd.isna(v)) for n, (v, at) in changed.items()]
        yield _frame(out, ["owner", "name", "value", "ts", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        old = [(name[0], value) for name, value in self.held.iterator() if value[1] + self.keep <= due]
        for name, _ in old:
            self.held.removeKey((name,))
        yield _frame([(key[0], n, None, _stamp(v[1] + self.keep), True) for n, v in old if v[0] is not None], ["owner", "name", "value", "ts", "gone"])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def keyed_store(writes: DataFrame, keep: str | None = None, late: str = "1 hour") -> DataFrame:
    """owner, name, value, ts, gone: each change of a store of JSON values by owner and name, as it happens.

    Writes are (owner, name, value, ts, write_id); a null value clears. The latest write by (ts, write_id) counts, in
    whatever order they come; a cleared name is remembered until it expires, so that an older write that comes late doesn't bring it
    back. With `keep`, what was not written for so long (by the watermark) expires, and that is a change too.
    """
    processor = KeyedStore(int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None)
    schema = "owner string, name string, value string, ts timestamp, gone boolean"
    return writes.withWatermark("ts", late).groupBy("owner").transformWithStateInPandas(processor, schema, "update", "EventTime")


def latest_values(changes: DataFrame) -> DataFrame:
    """owner, name, value: a snapshot of the store from all its written changes."""
    last = changes.groupBy("owner", "name").agg(F.max_by(F.struct("value", "gone"), F.struct("ts", "gone", "batch_id")).alias("c"))
    return last.filter("not c.gone").select("owner", "name", "c.value")


class BoundedHistory(StatefulProcessor):
    """The state of a series: its newest rows, no more than `most`, and none older than `keep` before the newest."""

    def __init__(self, most: int, keep_millis: int):
        self.most, self.keep = most, keep_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, event_id long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        held += [(_millis(t), int(e), float(v)) for t, e, v in _all(rows, ["ts"])[["ts", "event_id", "value"]].itertuples(index=False)]
        held = sorted(set(held), key=lambda r: r[:2], reverse=True)
        kept = [r for r in held if r[0] >= held[0][0] - self.keep][: self.most]
        self.rows.put(kept)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(kept[0][0] + self.keep)
        yield _frame([(key[0], n + 1, e, _stamp(at), v) for n, (at, e, v) in enumerate(kept)], ["series", "nth", "event_id", "ts", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield _frame([], ["series", "nth", "event_id", "ts", "value"]).astype({"series": "int64", "nth": "int64", "event_id": "int64", "ts": "datetime64[ns]", "value": "float64"})

    def close(self) -> None:
        pass


def bounded_history(events: DataFrame, most: int = 100, keep: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """series, nth, event_id, ts, value: on each batch, the history of each series that had rows in it, the newest first: at most
    `most` rows, none older than `keep` before the series' newest. The state holds just these, and is forgotten when
    the watermark has passed the newest one by `keep`. Rows that come again count once."""
    processor = BoundedHistory(most, int(pd.Timedelta(keep).total_seconds() * 1000))
    return events.select("series", "event_id", "ts", "value").withWatermark("ts", late).groupBy("series").transformWithStateInPandas(processor, HISTORY, "update", "EventTime")


class Watch(StatefulProcessor):
    """The state of a series: the time of its last row, and whether it counts as silent."""

    def __init__(self, after_millis: int):
        self.after = after_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, stale boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = _all(rows, ["ts"])["ts"]
        first, newest = _millis(times.iloc[0]), _millis(times.iloc[-1])
        known = self.last.get() if self.last.exists() else None
        out = []
        if known is None:
            out = [(key[0], "fresh", _stamp(first))]
        elif known[1] and newest > known[0]:
            out = [(key[0], "fresh", _stamp(first))]
        newest = max(newest, known[0]) if known else newest
        self.last.update((newest, bool(known and known[1] and not out)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.after)
        yield _notices(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        self.last.update((at, True))
        yield _notices([(key[0], "stale", _stamp(at + self.after))])

    def close(self) -> None:
        pass


def _notices(rows: list[tuple]) -> pd.DataFrame:
    return _frame(rows, ["series", "notice", "ts"]).astype({"series": "int64", "notice": "object", "ts": "datetime64[ns]"})


def staleness(polled: DataFrame, after: str = "5 seconds", late: str = "0 seconds") -> DataFrame:
    """series, notice, ts: 'stale' when a series has had no row for `after`, 'fresh' for its first row and for the first
    that comes back. Silence is judged by the watermark, so it shows as soon as other series go on."""
    processor = Watch(int(pd.Timedelta(after).total_seconds() * 1000))
    return polled.select("series", "ts").withWatermark("ts", late).groupBy("series").transformWithStateInPandas(processor, NOTICES, "append", "EventTime")
