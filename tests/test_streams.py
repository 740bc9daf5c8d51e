"""Keyed state, timers, repeated batches and progress of streams."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.operators.index import ChunkIndex
from lectern.streaming import arrivals, sinks, state


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    getValue, containsKey, updateValue, iterator = dict.get, dict.__contains__, dict.__setitem__, dict.items


class Items(Value):
    def get(self):
        return iter(self.held or [])

    put = Value.update


class Handle:
    """State and timers of one key, as plain Python."""

    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return Items()

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def test_a_silent_step_turns_to_an_error_and_is_forgotten():
    p = state.StepStates(patience=1000, forget=5000)
    p.init(Handle())
    event = lambda seq, stage, status, error=None: Row(seq=seq, stage=stage, status=status, error=error)
    first = list(p.handleInputRows((1,), iter([event(2, "search", "done"), event(1, "search", "in_progress")]), Clock(100)))
    assert [(r.stage, r.status, r.version) for r in first] == [("ranking", "in_progress", 1), ("search", "done", 2)]
    list(p.handleInputRows((1,), iter([event(3, "ranking", "in_progress")]), Clock(500)))
    assert p.handle.timers == [1500]  # only the latest
    p.handle.timers.clear()
    late = list(p.handleExpiredTimer((1,), Clock(1500), Clock(1500)))
    assert [(r.stage, r.status) for r in late] == [("ranking", "error")] and p.handle.timers == [6500]
    assert list(p.handleExpiredTimer((1,), Clock(6500), Clock(6500))) == [] and not p.seen and not p.run.exists()


def test_entries_are_a_bounded_ring_and_health_goes_on():
    p = state.LatestEntries(keep=20, last=10, every=30_000)
    p.init(Handle())
    rows = [Row(ts=(i * 37) % 1000, id=i, value=None if i % 50 == 0 else float(i)) for i in range(1000)]
    out = []
    for at in range(0, 1000, 250):
        out += p.handleInputRows((7,), iter(rows[at : at + 250]), Clock(at))
        assert len(list(p.entries.get())) <= 20
    tail = sorted(rows, key=lambda r: (r.ts, r.id))[-20:]
    mean = [r.value for r in tail[-10:] if r.value is not None]
    assert (out[-1].entries, out[-1].last_event) == (20, tail[-1].id) and out[-1].recent == pytest.approx(sum(mean) / len(mean))
    assert p.handle.timers == [30_000]
    health = list(p.handleExpiredTimer((7,), Clock(30_750), None))[0]
    assert (health.event, health.silent_ms, health.entries) == ("health", 30_000, 20) and p.handle.timers[-1] == 60_750


def test_timers_in_event_time(spark, tmp_path):
    """A question that hears nothing while the watermark passes its patience is reported; one that is done isn't."""
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    parts = [[(1, 0, "search", "in_progress", None, at(0)), (2, 0, "answer", "done", None, at(0))], [(3, 0, "search", "done", None, at(900))], [(3, 1, "ranking", "done", None, at(901))]]
    schema = "query_id long, seq long, stage string, status string, error string, ts timestamp"
    held = sinks.BatchTable(f"{tmp_path}/out", "steps")
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = arrivals.arriving(spark, f"{tmp_path}/in", schema).withWatermark("ts", "1 second")
        sinks.run_batches(state.stream_states(stream, patience=60_000, event_time="ts"), held.write, f"{tmp_path}/check", "update")
    last = sinks.last_written(held.read(spark, state.STEPS), "query_id", "stage", order=("version",)).collect()
    assert {(r["query_id"], r["stage"]): r["status"] for r in last} == {
        (1, "search"): "error", (2, "answer"): "done", (3, "search"): "done", (3, "ranking"): "done", (3, "context"): "in_progress",
    }


def test_arrivals_survive_a_batch_that_runs_again(spark, tmp_path):
    schema = "doc_id long, text string, arrived int"
    a = arrivals.Arrivals(spark, f"{tmp_path}/kept", "plain")
    long = " ".join(f"word{i}" for i in range(600))
    parts = [[(1, long, 1), (2, "two", 1), (None, "no id", 1)], [(1, "short now", 2), (1, "shorter", 1), (3, " ", 2), (2, "", 2)], [(3, "three at last", 3), (4, None, 3)]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        a.run(arrivals.arriving(spark, f"{tmp_path}/in", schema))
    texts = lambda: {r["doc_id"]: r["content"] for r in a.rows().collect()}
    want = {"1": "short now", "2": "two", "3": "three at last"}
    assert {k: v for k, v in texts().items() if k} == want and len([r for r in a.rows().collect() if r["doc_id"] == "1"]) == 1
    assert {r["doc_id"]: r["problem"] for r in a.problems().collect()} == {"4": "no text"}
    # as after a failure before the last commit: the batch is run again under its number
    (commit,) = [p for p in (tmp_path / "kept/checkpoint/commits").iterdir() if p.name == "2"]
    commit.unlink()
    (tmp_path / "kept/checkpoint/commits/.2.crc").unlink(missing_ok=True)
    a.run(arrivals.arriving(spark, f"{tmp_path}/in", schema))
    assert {k: v for k, v in texts().items() if k} == want and a.rows().where("doc_id is not null").count() == 3
    index = ChunkIndex(spark, f"{tmp_path}/index", buckets=4)
    index.create()
    index.upsert(a.rows().where("doc_id = '1'").withColumn("chunk_id", F.lit("1_9")))  # of an older, longer form
    a.fold(index)
    assert {(r["chunk_id"], r["content"]) for r in index.scan().where("doc_id is not null").collect()} == {("1_0", "short now"), ("2_0", "two"), ("3_0", "three at last")}
    assert a.rows().count() == 0
    spark.createDataFrame([(2, "two again", 4)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    a.run(arrivals.arriving(spark, f"{tmp_path}/in", schema))
    a.fold(index)
    assert {(r["chunk_id"], r["content"]) for r in index.scan().where("doc_id is not null").collect()} == {("1_0", "short now"), ("2_0", "two again"), ("3_0", "three at last")}


def test_documents_that_are_emptied_leave_the_index(spark, tmp_path):
    schema = "doc_id string, text string, arrived int"
    a = arrivals.Arrivals(spark, f"{tmp_path}/kept", "plain", emptied=True)
    index = ChunkIndex(spark, f"{tmp_path}/index", buckets=4)
    index.create()
    texts = lambda rows: {(r["doc_id"], r["content"]) for r in rows.collect()}
    a.write(spark.createDataFrame([("1", "one", 1), ("2", "two", 1), ("5", "five", 1), ("6", "six", 1)], schema), 0)
    a.fold(index)
    assert texts(index.scan()) == {("1", "one"), ("2", "two"), ("5", "five"), ("6", "six")} and a.problems().count() == 0
    a.write(spark.createDataFrame([("1", "one again", 2), ("3", "three", 2), ("4", "four", 3), ("4", "", 4), ("6", " ", 2)], schema), 1)
    for _ in range(2):  # also if run again
        a.write(spark.createDataFrame([("1", " \n", 5), ("2", "", 5), ("6", "six again", 5)], schema), 2)
    assert texts(a.rows()) == {("3", "three"), ("6", "six again")}
    assert {r["doc_id"]: r["problem"] for r in a.problems().collect()} == dict.fromkeys("124", "no text")
    a.fold(index)
    assert texts(index.scan()) == {("3", "three"), ("5", "five"), ("6", "six again")} and a.rows().count() == 0 == a.problems().count()


@pytest.mark.parametrize("few", [0, 100])
def test_a_fold_copies_and_shuffles_no_more_than_it_must(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(arrivals, "FEW", few)
    a = arrivals.Arrivals(spark, f"{tmp_path}/kept", "plain")
    index = ChunkIndex(spark, f"{tmp_path}/index", buckets=4)
    index.create()
    docs = lambda ids, text: spark.createDataFrame([(str(i), f"{text} {i}") for i in ids], "doc_id string, text string").repartition(8)
    a.write(docs(range(3, 43), "before"), 0)
    a.fold(index)
    gone = lambda *_, **__: pytest.fail("all rows are shuffled or copied")
    monkeypatch.setattr(arrivals, "last_written", gone)
    monkeypatch.setattr("lectern.operators.index.latest", gone)
    a.write(docs(range(40), "old"), 0)
    a.write(docs(range(30), "new"), 1)
    a.write(docs(range(40, 42), "new"), 2)
    a.fold(index)
    want = {f"new {i}" for i in [*range(30), 40, 41]} | {f"old {i}" for i in range(30, 40)} | {"before 42"}
    assert sorted(r["content"] for r in index.scan().collect()) == sorted(want)
    assert not spark.conf.get(sinks.SHUFFLES_DROPPED, None) == "true" and [x.name for x in tmp_path.iterdir() if "staged" in x.name or "-new-" in x.name] == []


def test_what_has_arrived_is_not_kept_in_the_inbox(spark, tmp_path, monkeypatch):
    from lectern.plans import streams

    monkeypatch.setattr(streams, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    seen = []
    run = lambda rows: sinks.run_batches(rows, lambda part, n: seen.append(sorted(r["id"] for r in part.collect())), f"{tmp_path}/check")
    streams._in_batches(spark, spark.range(7), "inbox", F.col("id") % 3, run)
    assert seen == [[0, 3, 6], [1, 4], [2, 5]] and not (tmp_path / "inbox").exists()


def test_batches_are_dropped_from_the_oldest_on(spark, tmp_path, monkeypatch):
    """A driver that stops midway leaves later batches, never an older form alone."""
    one, two = sinks.BatchTable(f"{tmp_path}/one", "r"), sinks.BatchTable(f"{tmp_path}/two", "r")
    for n in (10, 9, 2):
        one.write(spark.range(1), n)
    two.write(spark.range(1), 3)
    gone, folder = [], sinks.BatchTable._folder

    class Files:
        def __init__(self, files):
            self.files, self.globStatus = files, files.globStatus

        def delete(self, at, deep):
            gone.append(at.getName())
            return self.files.delete(at, deep)

    monkeypatch.setattr(sinks.BatchTable, "_folder", lambda self, spark: (Files(folder(self, spark)[0]), folder(self, spark)[1]))
    sinks.drop_batches(spark, one, two)
    assert gone == ["batch=2", "batch=3", "batch=9", "batch=10", "one", "two"] and not list(tmp_path.iterdir())


def test_progress_of_a_stream_that_fails(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    log = sinks.ProgressLog(spark, f"{tmp_path}/log")

    def fail(rows, n):
        raise ValueError("the sink is gone")

    with log:
        query = arrivals.arriving(spark, f"{tmp_path}/in", "id long").writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="the sink is gone"):
            query.awaitTermination()
        log.wait(query)
    rows = {r["event"]: r for r in log.read().collect()}
    assert "init" in rows and "the sink is gone" in rows["error"]["message"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    held = sinks.BatchTable(f"{tmp_path}/t", "r")
    for n in (0, 1, 1, 0):
        held.write(spark.range(n + 1), n)
    assert sorted((r["batch"], r["id"], r["run"]) for r in held.read(spark, "id long").collect()) == [(0, 0, "r"), (1, 0, "r"), (1, 1, "r")]
