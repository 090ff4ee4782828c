"""Which files have come in whole: a keyed stream of listings, with state and timers.

A file that is seen first counts as whole.  When its size or time changes it is being copied, until it has stood still
for ``stable`` seconds: then it is reported once, when a later listing shows it unchanged or, if nothing lists it again,
by a timer.  A file that nobody has listed for ``forget`` seconds is forgotten, so state is bounded by the files about.
What is reported depends on the listings and their times alone, not on how the stream is cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .history import upsert_batches

STABLE = 5.0
FORGET = 86_400.0
_STATE = "size long, mtime long, since long, last long, reported boolean"
OUTPUT = "path string, at long, event string, size long, mtime long"


class StabilityProcessor(StatefulProcessor):
    """State of a file: what it was when last listed, since when, and whether that has been reported.  Times are
    milliseconds since 1970, as timers are."""

    def __init__(self, stable: float = STABLE, forget: float = FORGET):
        self.stable, self.forget = int(stable * 1000), int(max(forget, stable) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, out = self._state(), []
        for r in sorted(rows, key=lambda r: (r.at, r.size, r.mtime)):
            if state and r.at < state["last"]:
                continue  # older than what is known
            if state and r.at - state["last"] > self.forget:
                out += self._settle(key, state, r.at)
                state = None
            if state is None:
                state = {"size": r.size, "mtime": r.mtime, "since": r.at, "last": r.at, "reported": True}
                out.append(self._row(key, r.at, "ready", state))
                continue
            out += self._settle(key, state, r.at)
            state["last"] = r.at
            if (r.size, r.mtime) != (state["size"], state["mtime"]):
                state.update(size=r.size, mtime=r.mtime, since=r.at, reported=False)
                out.append(self._row(key, r.at, "copying", state))
        self._keep(state)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, now = self._state(), expiredTimerInfo.getExpiryTimeInMs()
        if state is None:
            return
        yield from self._settle(key, state, now)
        self._keep(None if state["reported"] and now >= state["last"] + self.forget else state)

    def close(self) -> None:
        pass

    def _settle(self, key, state: dict, now: int) -> list[Row]:
        """The report that is due at ``now``, if any."""
        due = state["since"] + self.stable
        if state["reported"] or now < due:
            return []
        state["reported"] = True
        return [self._row(key, due, "ready", state)]

    def _state(self) -> dict | None:
        return dict(zip(("size", "mtime", "since", "last", "reported"), self.seen.get())) if self.seen.exists() else None

    def _keep(self, state: dict | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state is None:
            self.seen.clear()
            return
        self.seen.update(tuple(state[k] for k in ("size", "mtime", "since", "last", "reported")))
        self.handle.registerTimer(state["last"] + self.forget if state["reported"] else state["since"] + self.stable)

    @staticmethod
    def _row(key, at: int, event: str, state: dict) -> Row:
        return Row(path=key[0], at=at, event=event, size=state["size"], mtime=state["mtime"])


def settled_files(listings: DataFrame, *, stable: float = STABLE, forget: float = FORGET, delay: str = "0 seconds") -> DataFrame:
    """A stream of ``path, seen (timestamp), size, mtime`` -> ``path, at (ms), event, size, mtime``: ``ready`` at first sight
    and when a file has stood still, ``copying`` at each change.  Rows without a path or a time are left out; a null
    size or time of change counts as 0.  Listings may be late by ``delay``: those no newer than the
    newest of an earlier micro-batch less ``delay`` are passed over, and so are those older than their file's last."""
    rows = listings.where("path is not null and seen is not null").withWatermark("seen", delay)
    rows = rows.select(F.col("path").cast("string").alias("path"), "seen", F.unix_millis("seen").alias("at"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("size", "mtime")])
    return rows.groupBy("path").transformWithState(StabilityProcessor(stable, forget), OUTPUT, "Append", "EventTime")


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB, as keyed state with timers needs; the caller's
    settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Work off all that the stream has, each micro-batch written once under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    upsert_batches(stream, write, checkpoint).awaitTermination()
