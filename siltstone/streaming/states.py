"""Run states as keyed state of a stream: transitions in order of time, illegal ones counted, silent runs timed out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state that an event asks for.
ASKED = {"signup": "queued", "view": "running", "click": "running", "purchase": "succeeded", "error": "failed"}
#: States that can follow; any other demand is illegal and changes nothing. A finished run can be queued anew.
LEGAL = {
    "none": ("queued",), "queued": ("running", "failed"), "running": ("running", "succeeded", "failed"), "succeeded": ("queued",), "failed": ("queued",), "timed out": ("queued",),
}
#: States that time out.
OPEN = ("queued", "running")
RESULT = "user_id long, state string, n_events long, illegal long, timeouts long, since timestamp, version long"
#: Users are dealt to so many keys of the state, so that a batch costs a call a key at most, however many users it has.
KEYS = 4_096
#: What is kept of a key: its users' runs, and the events that wait for the watermark.
KEPT = (
    "user_id array<long>, state array<string>, since array<long>, n_events array<long>, illegal array<long>, timeouts array<long>, version array<long>, due array<long>, "
    "waiting_user array<long>, waiting_ts array<long>, waiting_id array<long>, waiting_type array<string>"
)
#: When a run is due that no timer ends.
NEVER = 1 << 62


@dataclass
class Run:
    """State, time (microseconds) of the last legal event, and counts."""

    state: str = "none"
    since: int = 0
    n_events: int = 0
    illegal: int = 0
    timeouts: int = 0

    def expire(self, now: int, limit: int) -> None:
        """Time out what has been silent for more than `limit` at `now`."""
        if self.state in OPEN and now > self.since + limit:
            self.state, self.timeouts = "timed out", self.timeouts + 1

    def take(self, ts: int, event_type: str, limit: int) -> None:
        self.n_events += 1
        self.expire(ts, limit)
        asked = ASKED.get(event_type)
        if asked in LEGAL[self.state]:
            self.state, self.since = asked, ts
        else:
            self.illegal += 1


@dataclass
class Kept:
    """The run up to the watermark, the number of its last row, when it times out (milliseconds), and the events after the watermark."""

    run: Run
    version: int
    due: int
    waiting: list[tuple]


class RunStates:
    """Keeps of each of a key's users the run up to the watermark and the events after it, and appends the run's state with all events so far whenever events or a timeout change it.

    Events wait until the watermark has passed them, so those that come out of order, but not late, are taken in order of time and id. What waits is
    bounded by the watermark's delay. State comes and goes with the batches of rows.
    """

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark, users = state.getCurrentWatermarkMs(), self._kept(state)
        changed = {user for user, kept in users.items() if kept.due < watermark}
        for frame in frames:  # an empty one, if the key is timed out
            for user, *event in zip(*(frame[c].tolist() for c in ("user_id", "us", "event_id", "event_type")), strict=True):
                if user not in users:
                    users[user] = Kept(Run(), 0, NEVER, [])
                users[user].waiting.append(tuple(event))
                changed.add(user)
        runs = {user: self._told(users[user], watermark) for user in changed}
        self._keep(state, users)
        if runs:
            columns = {"user_id": list(runs)} | {c: [getattr(run, c) for run in runs.values()] for c in ("state", "n_events", "illegal", "timeouts")}
            since = np.array([run.since if run.n_events > run.illegal else None for run in runs.values()], "datetime64[us]")
            yield pd.DataFrame(columns | {"since": since, "version": [users[user].version for user in runs]})

    def _told(self, kept: Kept, watermark: int) -> Run:
        """The run with all its events; `kept` takes those that the watermark has passed."""
        waiting = sorted(kept.waiting, key=lambda event: (event[0], event[1], event[2] or ""))
        passed = sum(ts <= watermark * 1000 for ts, _, _ in waiting)
        for ts, _, event_type in waiting[:passed]:
            kept.run.take(ts, event_type, self.limit)
        run = replace(kept.run)
        for ts, _, event_type in waiting[passed:]:
            run.take(ts, event_type, self.limit)
        run.expire(watermark * 1000, self.limit)
        kept.version, kept.waiting = kept.version + 1, waiting[passed:]
        # a key is called once the watermark is later than this; an event may move the time on
        kept.due = (run.since + self.limit) // 1000 if run.state in OPEN else NEVER
        return run

    def _kept(self, state: GroupState) -> dict[int, Kept]:
        if not state.exists:
            return {}
        ids, *runs, versions, dues, whose, times, event_ids, types = state.get
        users = {user: Kept(Run(*run), version, due, []) for user, *run, version, due in zip(ids, *runs, versions, dues, strict=True)}
        for user, *event in zip(whose, times, event_ids, types, strict=True):
            users[user].waiting.append(tuple(event))
        return users

    def _keep(self, state: GroupState, users: dict[int, Kept]) -> None:
        runs = [[getattr(kept.run, c) for kept in users.values()] for c in ("state", "since", "n_events", "illegal", "timeouts")]
        waiting = [(user, *event) for user, kept in users.items() for event in kept.waiting]
        dues = [kept.due for kept in users.values()]
        state.update((list(users), *runs, [kept.version for kept in users.values()], dues, *([event[k] for event in waiting] for k in range(4))))
        if min(dues) < NEVER:
            state.setTimeoutTimestamp(min(dues))


def run_states(events: DataFrame, limit: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """user_id, state, n_events, illegal, timeouts, since, version of a stream of events (event_id, ts, user_id, event_type): a row for each change, of which the one of largest version counts.

    A run that is queued or running for more than `limit` without a legal event is timed out, by the next event or, once the watermark (`late` behind the
    latest event) says so, by a timer. Rows later than the watermark are left out and counted by the operator. Events of null time or user are no run's; other
    types than the known ones are illegal. Equal times go by id.
    """
    limit_us = int(pd.Timedelta(limit).total_seconds() * 1_000_000)
    timed = events.where("ts is not null and user_id is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    keyed = timed.withWatermark("ts", late).withColumns({"us": F.unix_micros("ts"), "key": F.pmod(F.xxhash64("user_id"), F.lit(KEYS))})
    return keyed.groupBy("key").applyInPandasWithState(RunStates(limit_us), RESULT, KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def latest(changes: DataFrame) -> DataFrame:
    """The last row of each user, without its version."""
    last = F.max_by(F.struct("state", "n_events", "illegal", "timeouts", "since"), "version").alias("last")
    return changes.groupBy("user_id").agg(last).select("user_id", "last.*")
