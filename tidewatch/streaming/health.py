"""Source health over a stream of attempts that may come in any order."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.health import AFTER, HOURS, MOST_HOURS

# the process that plans the stream's state doesn't have this package's folder; the processor goes to it by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
OUTPUT = "source_id string, kind string, failures long, last_success timestamp, last_attempt timestamp, retry_after timestamp, attempt_id long, late long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP = 256
HOUR = 3_600_000_000
#: A time that isn't known: before all others.
NEVER = -(1 << 63)
_TIMES = ("last_success", "last_attempt", "retry_after")
_RUN = "good_ts long, good_id long, last_attempt long, settled long, settled_ts long, settled_id long, late long, listed long"
_COLUMNS = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


def backoff(failures: int) -> int | None:
    """Microseconds that a source waits after so many failures."""
    if failures < AFTER:
        return None
    return HOUR * (HOURS[failures - AFTER] if failures - AFTER < len(HOURS) else MOST_HOURS)


class Health(StatefulProcessor):
    """A source's failure run, last success and end of backoff, whatever order its attempts come in.

    Beside the counters, the state lists the newest ``keep`` failures after the last
    success. A success that comes late takes away the failures before it and leaves
    those after it, so the state is what a batch over all attempts says. Older failures
    are settled: only their number and the newest one's time stay. A success that is
    older than a settled failure and newer than the last success can't be placed among
    them any more; it changes nothing, is counted, and comes out as a row of kind ``late``.

    Rows of kind ``state`` are the state after a batch, of kind ``retry`` the end of a source's
    backoff, by a timer in processing time. Times are microseconds. A source has few attempts in a
    batch, so they are tuples: a data frame for each source would cost more than all else.
    """

    def __init__(self, keep: int = KEEP, timers: bool = True):
        self.keep, self.timers = keep, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _RUN)
        self.recent = handle.getListState("recent", "ts long, id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(NEVER if r["ts"] is None else r["ts"], r["attempt_id"], bool(r["ok"])) for r in rows if not r["quarantined"]]
        if not new:
            return
        good_ts, good_id, last, settled, settled_ts, settled_id, late, listed = self.run.get() or (None, None, NEVER, 0, None, None, 0, 0)
        good = None if good_ts is None else (good_ts, good_id)
        end = (settled_ts, settled_id)  # of the settled failures
        failed = [(x[0], x[1]) for x in self.recent.get()] if listed else []
        failed += [x[:2] for x in new if not x[2]]
        ok, unplaced = [x[:2] for x in new if x[2]], []
        if settled:
            unplaced = [x for x in ok if x <= end and (good is None or x > good)]
            ok = [x for x in ok if x > end or (good is not None and x <= good)]
        late += len(unplaced)
        if ok and (good is None or max(ok) > good):
            good = max(ok)
            if settled and good > end:
                settled = 0
        failed = sorted(x for x in failed if good is None or x > good)
        if settled:
            # a late failure among the settled ones is one more of them
            below = sum(x <= end for x in failed)
            settled, failed = settled + below, failed[below:]
        if len(failed) > self.keep:
            old, failed = failed[: -self.keep], failed[-self.keep :]
            settled, end = settled + len(old), old[-1]
        if not settled:
            end = (None, None)
        last = max(last, *[x[0] for x in new])
        self.run.update((*(good or (None, None)), last, settled, *end, late, len(failed)))
        if failed:
            self.recent.put(failed)
        elif listed:
            self.recent.clear()
        failures = settled + len(failed)
        wait = backoff(failures)
        until = last + wait if wait and last != NEVER else None
        if self.timers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if until is not None:
                self.handle.registerTimer(until // 1000)
        for kind, attempt in [("state", None), *[("late", x[1]) for x in unplaced]]:
            yield self._row(key, kind, failures, good, last, until, attempt, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        good_ts, good_id, last, settled, _, _, late, listed = self.run.get()
        good = None if good_ts is None else (good_ts, good_id)
        yield self._row(key, "retry", settled + listed, good, last, expiredTimerInfo.getExpiryTimeInMs() * 1000, None, late)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, kind, failures, good, last, until, attempt_id, late) -> Row:
        known = lambda ts: None if ts == NEVER else ts
        return _COLUMNS(key[0], kind, failures, known(good[0]) if good else None, known(last), until, attempt_id, late)


def source_health(attempts: DataFrame, keep: int = KEEP, timers: bool = True) -> DataFrame:
    """Rows of :class:`Health` for each source that had an attempt (source_id, attempt_id, ts, ok, quarantined), in update mode.

    Spark runs batches for timers also when no data come, so a stream that is to end by itself (``availableNow``)
    needs ``timers`` off; its rows still say when a source's backoff ends.
    The session's state store must be the one for keyed states and timers, ``STATE_STORE``.
    """
    narrow = attempts.select("source_id", "attempt_id", F.unix_micros("ts").alias("ts"), "ok", "quarantined")
    out = narrow.groupBy("source_id").transformWithState(Health(keep, timers), OUTPUT.replace("timestamp", "long"), "update", "processingTime" if timers else "none")
    return out.withColumns({c: F.timestamp_micros(c) for c in _TIMES})
