"""Leases: batch views of expiry, and claims as a keyed stream.

A lease is free, or held by a worker whose last heartbeat is younger than the timeout. Expiry
is looked at when a lease is read or asked for, as a poll would; a timer ends silent leases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expired_cleared(df: DataFrame, now: Column, timeout: int, worker: str = "worker", beat: str = "last_heartbeat_at") -> DataFrame:
    """Rows as a reader sees them: no worker where the heartbeat is older than the timeout (seconds)."""
    live = F.col(beat) >= now - F.make_interval(secs=F.lit(timeout))
    return df.withColumn(worker, F.when(F.coalesce(live, F.lit(False)), F.col(worker)))


def last_seen(events: DataFrame, by: str, at: str) -> DataFrame:
    """The last heartbeat of each key."""
    return events.groupBy(by).agg(F.max(at).alias("last_seen"))


def heartbeat_failures(beats: DataFrame, interval: int, by: str = "task", at: str = "at", status: str = "status") -> DataFrame:
    """Per task, when and why its lease is lost: at once on 403 or 409, else when no success came for two intervals."""
    upto = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col(status).between(200, 299)
    good = F.max(F.when(ok, F.col(at))).over(upto)
    start = F.min(at).over(Window.partitionBy(by))
    late = ~F.coalesce(ok, F.lit(False)) & (F.unix_timestamp(at) - F.unix_timestamp(F.coalesce(good, start)) >= 2 * interval)
    why = F.when(F.col(status).isin(403, 409), F.concat(F.lit("status "), F.col(status))).when(late, "no heartbeat")
    lost = beats.withColumn("why", why).filter("why is not null")
    return lost.groupBy(by).agg(F.min(at).alias("lost_at"), F.min_by("why", at).alias("why"))


def first_cancellation(requests: DataFrame, by: str, at: str, reason: str) -> DataFrame:
    """The first reason given; later ones change nothing."""
    return requests.groupBy(by).agg(F.min_by(reason, F.struct(at, reason)).alias("reason"), F.min(at).alias("at"))


def lapsed_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """Claimed or running tasks whose lease is over."""
    return tasks.filter(F.col("status").isin("claimed", "running") & (F.col("lease_expires_at") < now))


ANSWER = "key string, worker string, at timestamp, status int, holder string"
STATE = "holder string, beat double"


def claims(commands: DataFrame, timeout: int) -> DataFrame:
    """A stream of commands (key, worker, at, command, active) answered in order of time within each key.

    Commands: claim, heartbeat, release. 200: done (a claim by the holder is one); 403: the
    key's project is not active; 409: another live worker holds it, or it is not the sender's.
    State is the holder and its last heartbeat. A lease ends by the times of the commands, not by
    the clock of the machine: its state goes when the watermark, one timeout behind the newest
    command, has passed the heartbeat by more than the timeout. Commands later than the
    watermark are dropped. The commands of a key in one micro-batch are answered together.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        holder, beat = state.get if state.exists else (None, 0.0)
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames))
        if len(frame):
            frame = frame.sort_values(["at", "worker", "command"], kind="stable")
            answers, holders = [], []
            for worker, at, command, active in zip(frame["worker"], frame["at"], frame["command"], frame["active"], strict=True):
                now = at.timestamp()
                if holder is not None and now - beat > timeout:
                    holder = None
                if not active:
                    status = 403
                elif command == "claim" and holder in (None, worker) or command != "claim" and holder == worker:
                    status, beat = 200, now
                    holder = None if command == "release" else worker
                else:
                    status = 409
                answers.append(status)
                holders.append(holder)
            yield pd.DataFrame({"key": key[0], "worker": frame["worker"], "at": frame["at"], "status": answers, "holder": holders})
        if holder is None:
            state.remove() if state.exists else None
        else:
            state.update((holder, beat))
            state.setTimeoutTimestamp(max(int((beat + timeout) * 1000), state.getCurrentWatermarkMs()) + 1)

    timed = commands.withWatermark("at", f"{timeout} seconds")
    return timed.groupBy("key").applyInPandasWithState(step, ANSWER, STATE, "append", "EventTimeTimeout")
