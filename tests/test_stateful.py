"""Streams with state, run batch by batch over landed files and from their checkpoints."""

import json
from datetime import datetime, timedelta

import pytest

from tidewater.streaming import feeds, sinks, stateful

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Stream:
    """A stream over a folder into a table of batches; run() takes what has landed since, from the checkpoint."""

    def __init__(self, spark, folder, schema, build, mode):
        self.spark, self.folder, self.schema, self.build, self.mode = spark, folder, schema, build, mode

    def run(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
            query = self.build(feeds.landed(self.spark, f"{self.folder}/in", self.schema)).writeStream.outputMode(self.mode).foreachBatch(sinks.to_table(f"{self.folder}/out")).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            assert query.awaitTermination(240)
            if query.exception():
                raise query.exception()
        return self.table()

    def table(self):
        return self.spark.read.parquet(f"{self.folder}/out")


def test_keyed_store_over_restarts(rocks, tmp_path):
    """Each run() is a restart: writes, overwrites, late writes, clears and expiry."""
    w = lambda i, s, name, value, owner="a": (owner, name, value, at(s), i)
    stream = Stream(rocks, str(tmp_path), stateful.WRITES, lambda x: stateful.keyed_store(x, keep="1 hour", late="0 seconds"), "update")
    held = lambda: {(r.owner, r.name): r.value for r in stateful.latest_values(stream.table()).collect()}
    stream.run([w(1, 0, "page", '{"p": 1}'), w(2, 5, "page", '{"p": 2}'), w(3, 3, "page", '{"p": 9}'), w(4, 1, "seen", "[1]")])
    assert held() == {("a", "page"): '{"p": 2}', ("a", "seen"): "[1]"}
    stream.run([w(5, 60, "seen", None), w(6, 60, "page", '{"p": 3}', "b")], [w(7, 61, "seen", "[2]"), w(8, 62, "other", "{}")])
    assert held() == {("a", "page"): '{"p": 2}', ("a", "seen"): "[2]", ("a", "other"): "{}", ("b", "page"): '{"p": 3}'}
    stream.run([w(9, 62, "seen", None)], [w(10, 3700, "new", "1", "c")], [w(11, 3900, "new", "2", "c")])
    assert held() == {("c", "new"): "2"}
    gone = {(r.owner, r.name): r.ts for r in stream.table().filter("gone").collect()}
    assert gone[("a", "page")] == at(5 + 3600) and gone[("b", "page")] == at(60 + 3600) and ("a", "seen") in gone


def test_a_cleared_name_is_not_brought_back_by_an_older_write(rocks, tmp_path):
    stream = Stream(rocks, str(tmp_path), stateful.WRITES, lambda x: stateful.keyed_store(x, late="1 hour"), "update")
    stream.run([("a", "n", "1", at(0), 1), ("a", "n", None, at(9), 3)], [("a", "n", "2", at(5), 2)])
    assert stateful.latest_values(stream.table()).collect() == []


def test_bounded_history(rocks, tmp_path):
    """10,000 events in four batches: what is held at the end is the newest 100 of a day, per series."""
    rows = [(i, i % 3, "k", at(i * 37 % 10_000 * 20 + (0 if i % 3 else i)), float(i)) for i in range(10_000)]
    stream = Stream(rocks, str(tmp_path), feeds.EVENTS, lambda x: stateful.bounded_history(x, late="30 days"), "update")
    batches = [rows[i : i + 2500] for i in range(0, 10_000, 2500)] + [rows[:5]]
    out = stream.run(*batches)
    last = {}
    for r in out.collect():
        last.setdefault((r.series, r.batch_id), []).append((r.nth, r.event_id, r.ts, r.value))
    assert max(map(len, last.values())) <= 100
    for series in range(3):
        mine = sorted(((e[3], e[0], e[4]) for e in rows if e[1] == series), reverse=True)
        want = [x for x in mine if x[0] >= mine[0][0] - timedelta(days=1)][:100]
        newest = max(b for s, b in last if s == series)
        assert [(e, t, v) for _, e, t, v in sorted(last[series, newest])] == [(e, t, v) for t, e, v in want]


def test_history_is_forgotten_when_a_series_ends(rocks, tmp_path):
    row = lambda i, series, s: (i, series, "k", at(s), float(i))
    stream = Stream(rocks, str(tmp_path), feeds.EVENTS, lambda x: stateful.bounded_history(x, late="0 seconds"), "update")
    out = stream.run([row(1, 1, 0), row(2, 1, 5)], [row(3, 2, 90_000)], [row(4, 2, 90_001)], [row(5, 1, 90_002)])
    assert sorted((r.nth, r.event_id) for r in out.filter("series = 1").orderBy("batch_id").collect() if r.ts >= at(90_000)) == [(1, 5)]
    assert out.filter("series = 1 and nth > 2").count() == 0


def test_silence_and_return(rocks, tmp_path):
    row = lambda i, series, s: (i, series, "k", at(s), 0.0)
    stream = Stream(rocks, str(tmp_path), feeds.EVENTS, lambda x: stateful.staleness(x, "5 seconds"), "append")
    out = stream.run([row(1, 1, 0), row(2, 2, 0)], [row(3, 2, 4)], [row(4, 2, 8)], [row(5, 2, 12)], [row(6, 1, 30), row(7, 2, 30)], [row(8, 2, 31)])
    got = sorted((r.series, r.ts, r.notice) for r in out.collect())
    assert [(t, n) for s, t, n in got if s == 1] == [(at(0), "fresh"), (at(5), "stale"), (at(30), "fresh")]
    assert [n for s, _, n in got if s == 2][:1] == ["fresh"] and (2, at(9), "stale") not in got


def test_an_endpoint_has_one_body_a_batch(spark, tmp_path):
    endpoint = f"file://{tmp_path}/apr"
    report = lambda b: b.selectExpr("sum(value) AS total", "count(*) AS n")
    write = sinks.to_endpoint(endpoint, report)
    one = spark.createDataFrame([(1.0,), (2.0,)], "value double")
    two = spark.createDataFrame([(5.0,)], "value double")
    assert sinks.body(spark, endpoint) is None
    write(one, 0)
    assert json.loads(sinks.body(spark, endpoint)) == {"total": 3.0, "n": 2}
    write(two, 1)
    write(one, 0)  # replayed: done before
    assert json.loads(sinks.body(spark, endpoint)) == {"total": 5.0, "n": 1}
    assert sorted(p.name for p in (tmp_path / "apr").iterdir() if not p.name.startswith(".")) == ["_batches", "body.json"]
    assert not sinks.replace_body(two.limit(0), endpoint, 2) and json.loads(sinks.body(spark, endpoint))["n"] == 1
    (tmp_path / "apr" / "_batches" / "1").unlink()  # failed before its mark: written again
    assert sinks.replace_body(report(two), endpoint, 1)


def test_an_endpoint_over_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    for rows in ([(1, 1, "k", at(0), 2.0)], [(2, 1, "k", at(1), 3.0), (3, 1, "k", at(2), 4.0)]):
        spark.createDataFrame(rows, feeds.EVENTS).coalesce(1).write.mode("append").parquet(source)
        query = feeds.landed(spark, source).writeStream.foreachBatch(sinks.to_endpoint(f"{tmp_path}/body", lambda b: b.selectExpr("sum(value) AS total"))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    assert json.loads(sinks.body(spark, f"{tmp_path}/body")) == {"total": 7.0}


def test_cooldown_forgets(spark, tmp_path):
    """A key whose cooldown is over leaves the state."""
    row = lambda i, s, kind: (i, 1, kind, at(s), 0.0)
    stream = Stream(spark, str(tmp_path), feeds.EVENTS, lambda e: feeds.cooled(e.select("series", "kind", "ts"), 300.0, "0 seconds"), "append")
    out = stream.run([row(1, 0, "a"), row(2, 0, "b")], [row(3, 1000, "c")], [row(4, 1001, "c"), row(5, 1002, "a")], [row(6, 1003, "a")])
    assert sorted((r.kind, r.ts) for r in out.collect()) == [("a", at(0)), ("a", at(1002)), ("b", at(0)), ("c", at(1000))]
