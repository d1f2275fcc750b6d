"""Lifecycle of opportunities: a state machine per key, folded in order of arrival, as a batch or with state on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pricelens.streaming.state import state_on_disk

STATES = ("active", "stale", "suspended", "disqualified", "closed")
HEAD = "version long, state string, reason string, command string, at_ms long, expires_ms long"
OUT = "key string, command string, outcome string, version long, from_state string, to_state string, at_ms long, reason string, expires_ms long"
COLUMNS = [x.split()[0] for x in OUT.split(", ")]
#: What a passed expiry does to an active head.
EXPIRED = ("stale", "candidate-evidence-stale", None)


def advance(head: tuple | None, command: str, at_ms: int, state: str, reason: str, expires_ms: int | None) -> tuple[tuple, str]:
    """The head after a command, and duplicate, closed, ignored-older, noop or transition."""
    if head is not None:
        version, old_state, old_reason, old_command, old_at, old_expires = head
        if old_command == command:
            return head, "duplicate"
        if old_state == "closed":
            return head, "closed"
        if at_ms < old_at:
            return head, "ignored-older"
        if (old_state, old_reason, old_expires) == (state, reason, expires_ms):
            return head, "noop"
    return ((head[0] if head else 0) + 1, state, reason, command, at_ms, expires_ms), "transition"


def sweep_command(key: str, due_ms: int) -> str:
    return f"sweep:{key}:{due_ms}"


def _whole(x: Any) -> int | None:
    return None if pd.isna(x) else int(x)


def _row(key: str, command: str, outcome: str, before: tuple | None, head: tuple, at_ms: int) -> tuple:
    return key, command, outcome, head[0], before[1] if before else None, head[1], at_ms, head[2], head[5]


def _rows(found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=COLUMNS)
    return out.assign(expires_ms=out["expires_ms"].astype("Int64"))


def fold(commands: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """commands (key, seq, command, at_ms, state, reason, expires_ms): what each of them did, and the head after it.

    A key's commands are sorted into one partition and walked in order, a batch at a time, with one head in memory; many
    keys share a task. The fold of one key can't be split, for each step depends on the one before.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, head = object(), None
        for pdf in batches:
            rows = []
            for k, command, at, state, reason, expires in zip(pdf["key"], pdf["command"], pdf["at_ms"].tolist(), pdf["state"], pdf["reason"], pdf["expires_ms"]):
                if k != now:
                    now, head = k, None
                before = head
                head, outcome = advance(head, command, at, state, reason, _whole(expires))
                rows.append(_row(k, command, outcome, before, head, at))
            yield _rows(rows)

    own = commands.select(F.col(key).cast("string").alias("key"), F.col(order).alias("seq"), "command", "at_ms", "state", "reason", "expires_ms")
    return own.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(walk, OUT)


class Lifecycle(StatefulProcessor):
    """A key's head as state. An active head with an expiry has one timer, which makes it stale when its time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.head = handle, handle.getValueState("head", HEAD)

    def _held(self) -> tuple | None:
        return tuple(self.head.get()) if self.head.exists() else None

    def _hold(self, head: tuple) -> None:
        self.head.update(head)
        wanted = [head[5]] if head[1] == "active" and head[5] is not None else []
        set_ = list(self.handle.listTimers())
        for at in set_:
            if at not in wanted:
                self.handle.deleteTimer(at)
        for at in wanted:
            if at not in set_:
                self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        head, found = self._held(), []
        for r in pd.concat(rows).sort_values("seq", kind="stable").itertuples(index=False):
            before = head
            head, outcome = advance(head, r.command, int(r.at_ms), r.state, r.reason, _whole(r.expires_ms))
            found.append(_row(key[0], r.command, outcome, before, head, int(r.at_ms)))
        self._hold(head)
        yield _rows(found)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, before = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        found = []
        if before and before[1] == "active" and before[5] is not None and before[5] <= due:
            command, at = sweep_command(key[0], due), max(due, before[4])
            head, outcome = advance(before, command, at, *EXPIRED)
            self.head.update(head)
            found.append(_row(key[0], command, outcome, before, head, at))
        yield _rows(found)

    def close(self) -> None:
        pass


def start_fold(commands: DataFrame, path: str, checkpoint: str, **trigger):
    """The fold of a stream of commands: a folder of what each batch's commands and timers did; returns the started query.

    Heads live in the state store on disk. Timers go by the clock: one that is due fires in the next batch. With a trigger
    given (processingTime="1 minute") that is at most so much later; without one the query ends with its input, and timers
    wait for the next start. A batch that is
    repeated after a failure writes its folder again; a query started again from its checkpoint goes on from its heads.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_on_disk(commands.sparkSession, empty_batches=bool(trigger)):
        done = commands.groupBy("key").transformWithStateInPandas(Lifecycle(), OUT, "update", "processingTime")
        return done.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def heads(folded: DataFrame) -> DataFrame:
    """The last state of each key: key, version, state, reason, at_ms, expires_ms."""
    done = folded.where("outcome = 'transition'")
    head = F.struct("version", F.col("to_state").alias("state"), "reason", "at_ms", "expires_ms")
    return done.groupBy("key").agg(F.max_by(head, "version").alias("h")).select("key", "h.*")


def expired(heads_: DataFrame, now_ms: int) -> DataFrame:
    """Active heads past their expiry, as commands that make them stale."""
    state, reason, _ = EXPIRED
    return heads_.where((F.col("state") == "active") & (F.col("expires_ms") <= now_ms)).select(
        "key", F.concat(F.lit("sweep:"), "key", F.lit(":"), F.lit(now_ms).cast("string")).alias("command"), F.lit(now_ms).cast("long").alias("at_ms"),
        F.lit(state).alias("state"), F.lit(reason).alias("reason"), F.lit(None).cast("long").alias("expires_ms"),
    )


def swept(commands: DataFrame, now_ms: int) -> DataFrame:
    """Heads after the commands and then a sweep at an instant."""
    sweep = expired(heads(fold(commands)), now_ms).withColumn("seq", F.lit((1 << 63) - 1))
    return heads(fold(commands.select("key", "seq", "command", "at_ms", "state", "reason", "expires_ms").unionByName(sweep)))
