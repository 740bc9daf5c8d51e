"""Keyed state with timers: steps of running questions, and the latest entries and health of sessions.

What a key holds is bounded: four steps, or a ring of ``keep`` entries. Rows may come in any order and in any batches; the state after
the last is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .events import STAGES

STEPS = "query_id long, stage string, status string, version long"


class StepStates(StatefulProcessor):
    """The status of each step of a question, a row whenever one changes.

    The last event of a step decides; a step done puts the next, if that has no event yet, in progress; an error event, or ``patience``
    milliseconds in which nothing is heard while a step is in progress, turns steps in progress to errors. ``forget`` milliseconds
    later the question's state goes.
    """

    def __init__(self, patience: int | None = None, forget: int = 3_600_000, event_time: bool = False):
        self.patience, self.forget, self.event_time = patience, forget, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "stage string", "status string, seq long")
        self.shown = handle.getMapState("shown", "stage string", "status string")
        self.run = handle.getValueState("run", "version long, failed boolean, silent boolean")

    def _statuses(self, failed: bool) -> dict[str, str]:
        last = {stage: value[0] for (stage,), value in self.seen.iterator()}
        for stage, after in zip(STAGES, STAGES[1:]):
            if last.get(stage) == "done" and after not in last:
                last[after] = "waiting"
        now = {s: "in_progress" if v == "waiting" else v for s, v in last.items()}
        return {s: "error" if failed and v == "in_progress" else v for s, v in now.items()}

    def _changed(self, key, version: int, failed: bool, silent: bool) -> Iterator[Row]:
        before = {stage: value[0] for (stage,), value in self.shown.iterator()}
        for stage, status in sorted(self._statuses(failed).items()):
            if before.get(stage) != status:
                version += 1
                self.shown.updateValue((stage,), (status,))
                yield Row(query_id=key[0], stage=stage, status=status, version=version)
        self.run.update((version, failed, silent))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, failed, _ = self.run.get() if self.run.exists() else (0, False, False)
        heard = 0
        for r in rows:
            failed = failed or r.error is not None
            if self.event_time:
                heard = max(heard, int(r.ts.timestamp() * 1000))
            if r.stage is not None:
                held = self.seen.getValue((r.stage,)) if self.seen.containsKey((r.stage,)) else None
                if held is None or r.seq >= held[1]:
                    self.seen.updateValue((r.stage,), (r.status, r.seq))
        if self.patience:
            now = heard if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self._wake(now + self.patience)
        yield from self._changed(key, version, failed, False)

    def _wake(self, at: int) -> None:
        """One timer a key: what was set before goes."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        version, failed, silent = self.run.get() if self.run.exists() else (0, False, True)
        if silent:  # the second time
            for state in (self.seen, self.shown, self.run):
                state.clear()
            return
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.forget)
        yield from self._changed(key, version, True, True)


def stream_states(events: DataFrame, patience: int | None = None, forget: int = 3_600_000, event_time: str | None = None) -> DataFrame:
    """Changes of step states for a stream of ``query_id``, ``seq``, ``stage``, ``status``, ``error`` (and ``ts``, watermarked, for timers in event time)."""
    cols = ["query_id", F.col("seq").cast("long").alias("seq"), "stage", "status", "error", *([F.col(event_time).alias("ts")] if event_time else [])]
    time_mode = "EventTime" if event_time else "ProcessingTime" if patience else "None"
    return events.select(*cols).groupBy("query_id").transformWithState(
        StepStates(patience, forget, bool(event_time)), STEPS, "Update", time_mode
    )


HISTORY = "session_id long, event string, version long, entries long, last_event long, recent double, silent_ms long"


class LatestEntries(StatefulProcessor):
    """The latest ``keep`` entries of a session, in order of time and id however they arrive, as one bounded list.

    After each batch there is a row with the mean of the latest ``last``; every ``every`` milliseconds, whether or not anything
    came, one that tells how long nothing did.
    """

    def __init__(self, keep: int = 20, last: int = 10, every: int | None = None):
        self.keep, self.last, self.every = keep, last, every

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "ts long, id long, value double")
        self.run = handle.getValueState("run", "version long, heard long, timed boolean")

    def _row(self, key, event: str, version: int, held: list, silent: int) -> Row:
        tail = [v for _, _, v in held[-self.last :] if v is not None]
        recent = sum(tail) / len(tail) if tail else None
        return Row(session_id=key[0], event=event, version=version, entries=len(held), last_event=held[-1][1] if held else None, recent=recent, silent_ms=silent)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, _, timed = self.run.get() if self.run.exists() else (0, 0, False)
        held = [tuple(e) for e in self.entries.get()]
        for r in rows:
            held.append((r.ts, r.id, r.value))
            if len(held) >= 16 * self.keep:  # so that a batch of any size is held in bounds
                held = sorted(held, key=lambda e: e[:2])[-self.keep :]
        held = sorted(held, key=lambda e: e[:2])[-self.keep :]
        self.entries.put(held)
        now = timerValues.getCurrentProcessingTimeInMs() if self.every else 0
        if self.every and not timed:
            self.handle.registerTimer(now + self.every)
        self.run.update((version + 1, now, bool(self.every)))
        yield self._row(key, "entries", version + 1, held, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        version, heard, _ = self.run.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.every)
        self.run.update((version + 1, heard, True))
        yield self._row(key, "health", version + 1, [tuple(e) for e in self.entries.get()], now - heard)


def stream_history(entries: DataFrame, keep: int = 20, last: int = 10, every: int | None = None) -> DataFrame:
    """Rows of the latest entries of a stream of ``session_id``, ``ts``, ``event_id``, ``response_time``."""
    rows = entries.select(
        "session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), F.col("response_time").cast("double").alias("value")
    )
    return rows.groupBy("session_id").transformWithState(LatestEntries(keep, last, every), HISTORY, "Update", "ProcessingTime" if every else "None")
