"""Streams over landed files, run to their end."""

from datetime import datetime, timedelta, timezone

import pandas as pd

from tidewater.streaming import feeds

T0 = datetime(2024, 1, 1)


def run(spark, tmp_path, rows, build, mode):
    folder, name = str(tmp_path / "in"), "out_" + "_".join(tmp_path.parts[-2:]).replace("-", "_")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, feeds.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    query = build(feeds.landed(spark, folder, files=1)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.table(name).collect()


def event(i, s, v, kind="k"):
    return (i, 1, kind, T0 + timedelta(seconds=s), v)


def test_buckets(spark, tmp_path):
    got = run(spark, tmp_path, [[event(1, 0, 2.0), event(2, 90000, 3.0)]], feeds.bucketed, "complete")
    assert sorted((r.n, r.total) for r in got) == [(1, 2.0), (1, 3.0)]


class State:
    """Stands in for a group's state between batches."""

    exists = hasTimedOut = False

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, millis):
        self.until = millis

    def getCurrentWatermarkMs(self):
        return 0


def frame(*rows):
    return pd.DataFrame({"ts": [pd.Timestamp(T0) + pd.Timedelta(seconds=s) for s, _ in rows], "value": [v for _, v in rows]})


def test_accumulation_goes_on_over_batches():
    state, step = State(), feeds.accumulate_step(1000)
    totals = [next(step((1,), iter([frame(r)]), state))["total"][0] for r in ((0, 2.0), (10, 5.0), (12, 0.0))]
    assert totals == [0.0, 20.0, 30.0] and state.until == int((T0 + timedelta(seconds=12)).replace(tzinfo=timezone.utc).timestamp() * 1000) + 1000


def test_cooldown():
    state, step = State(), feeds.cooldown_step(300)
    shown = [len(next(step((1, "k"), iter([b]), state))) for b in (frame((0, 1.0), (100, 1.0)), frame((299, 1.0), (301, 1.0)))]
    assert shown == [1, 1]


def test_notifications_come_once(spark, tmp_path):
    got = run(spark, tmp_path, [[event(1, 0, 1.0), event(2, 1, 1.0)], [event(1, 2, 1.0), event(3, 3, 1.0)]], feeds.notifications, "append")
    assert sorted(r.event_id for r in got) == [1, 2, 3]


def test_accumulation_as_a_stream(spark, tmp_path):
    rows = [[event(1, 0, 2.0)], [event(2, 10, 5.0), event(3, 12, 0.0)]]
    got = run(spark, tmp_path, rows, lambda e: feeds.accumulated(e.select("series", "ts", "value")), "update")
    assert max(r.total for r in got) == 30.0


def test_cooldown_as_a_stream(spark, tmp_path):
    rows = [[event(1, 0, 1.0), event(2, 100, 1.0)], [event(3, 301, 1.0), event(4, 10, 1.0, "other")]]
    got = run(spark, tmp_path, rows, lambda e: feeds.cooled(e.select("series", "kind", "ts")), "append")
    assert sorted((r.kind, (r.ts - T0).total_seconds()) for r in got) == [("k", 0.0), ("k", 301.0), ("other", 10.0)]


def test_sessions_and_sliding_windows(spark, tmp_path):
    late = event(9, 4 * 86400, 0.0)
    got = run(spark, tmp_path / "a", [[event(1, 0, 2.0), event(2, 60, 7.0), event(3, 3600, 1.0)], [late]], feeds.sessions, "append")
    assert sorted((r.n, r.gain) for r in got) == [(1, 0.0), (2, 5.0)]
    got = run(spark, tmp_path / "b", [[event(1, 0, 2.0)], [late]], lambda e: feeds.sliding(e, "2 hours", "1 hour"), "append")
    assert sorted(r.total for r in got) == [2.0, 2.0]
