"""Stateful feeds: vehicle safety, stuck vehicles, job status and the edit log."""

from __future__ import annotations

import sys
from typing import Any, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mapweave.operators.jobs import TERMINAL
from mapweave.streaming.session import use_rocksdb

# Workers get the processors themselves, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pose safety, recovery and stuck rules.
UPRIGHT, LOW, HIGH = 0.72, 0.45, 3.2
SAFE_SECONDS, RECOVER_SECONDS, FALL = 0.6, 2.5, -8.0
STUCK_SECONDS, STUCK_KPH, STUCK_THROTTLE, TIPPED = 3.0, 2.0, 0.25, 0.25


def pose_is_safe(upright: Column, height: Column, inside: Column) -> Column:
    return (upright > UPRIGHT) & inside & (height > LOW) & (height < HIGH)


def pose_is_stuck(speed_kph: Column, throttle: Column, upright: Column) -> Column:
    return ((speed_kph < STUCK_KPH) & (throttle > STUCK_THROTTLE)) | (upright < TIPPED)


def watch(state: dict, time: float, safe: bool, height: float, stuck: bool) -> dict:
    """Update the counters with one pose in place; tells which thresholds were reached."""
    step = 0.0 if state["last"] is None else time - state["last"]
    event = {"saved": False, "recover": False, "stuck": False}
    if safe:
        state["unsafe"], state["safe"] = 0.0, state["safe"] + step
        if state["safe"] >= SAFE_SECONDS:
            state["safe"], event["saved"] = 0.0, True
    else:
        state["safe"], state["unsafe"] = 0.0, state["unsafe"] + step
        if state["unsafe"] >= RECOVER_SECONDS or height < FALL:
            state["unsafe"], event["recover"] = 0.0, True
    state["stuck"] = state["stuck"] + step if stuck else max(0.0, state["stuck"] - 2 * step)
    if state["stuck"] > STUCK_SECONDS:
        state["stuck"], event["stuck"] = 0.0, True
    state["last"] = time
    return event


class Expiring(StatefulProcessor):
    """A processor whose keys are forgotten once event time has passed ``idle`` seconds since their last row.

    One timer a key: when it is due early, because more rows came, it is set again. A row older than the last one taken is told
    of as late and changes nothing; rows older than the watermark are dropped by Spark and counted in its progress.
    """

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last double, due long")

    def last_seen(self) -> float | None:
        return self.seen.get()[0] if self.seen.exists() else None

    def remember(self, last: float) -> None:
        """Note the time of the newest row, and set a timer if there is none."""
        due = self.seen.get()[1] if self.seen.exists() else None
        if due is None:
            due = int((last + self.idle) * 1000)
            self.handle.registerTimer(due)
        self.seen.update((float(last), due))

    def forget(self) -> None:
        """Clear further state."""

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.last_seen()
        due = None if last is None else int((last + self.idle) * 1000)
        if due is not None and due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            self.seen.update((last, due))
        else:
            self.seen.clear()
            self.forget()
        yield from ()

    def close(self) -> None:
        pass


def in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """One key's rows of one batch, which the trigger's limits bound, in order."""
    return pd.concat(list(rows)).sort_values(order)


class VehicleMonitor(Expiring):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counters = handle.getValueState("counters", "safe double, unsafe double, stuck double, last double")

    def forget(self) -> None:
        self.counters.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        poses = in_order(rows, ["ts"])
        names = ("safe", "unsafe", "stuck", "last")
        state = dict(zip(names, self.counters.get() if self.counters.exists() else (0.0, 0.0, 0.0, None)))
        out = []
        for ts, time, safe, height, stuck in zip(poses["ts"], poses["time"], poses["safe"], poses["height"], poses["stuck"]):
            if state["last"] is not None and time < state["last"]:
                out.append((*key, ts, "late"))
                continue
            event = watch(state, float(time), bool(safe), float(height), bool(stuck))
            out.extend((*key, ts, name) for name, hit in event.items() if hit)
        self.counters.update(tuple(state[n] for n in names))
        self.remember(state["last"])
        yield pd.DataFrame(out, columns=[*TRACE, "ts", "event"])


TRACE = ["area_id", "trace_id"]


def vehicle_events(poses: DataFrame, delay: str = "30 seconds", idle: float = 3600.0) -> DataFrame:
    """Safe points, recoveries, stuck alerts and late poses of each trace of each area.

    Poses: ``area_id, trace_id, ts, upright, height, inside, speed_kph, throttle``; without ``area_id`` all are of area 0. A trace
    is forgotten when event time has passed ``idle`` seconds since its last pose.
    """
    use_rocksdb(poses.sparkSession)
    area = F.col("area_id").cast("long") if "area_id" in poses.columns else F.lit(0).cast("long")
    ready = poses.withWatermark("ts", delay).select(
        area.alias("area_id"), "trace_id", "ts", (F.unix_micros("ts") / 1e6).alias("time"), F.col("height").cast("double").alias("height"),
        pose_is_safe(F.col("upright"), F.col("height"), F.col("inside")).alias("safe"),
        pose_is_stuck(F.col("speed_kph"), F.col("throttle"), F.col("upright")).alias("stuck"),
    )
    return ready.groupBy(*TRACE).transformWithStateInPandas(
        VehicleMonitor(idle), "area_id long, trace_id long, ts timestamp, event string", "append", "EventTime"
    )


class JobFeed(Expiring):
    """Passes on a job's status when it differs from the last one, until a terminal status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "status string, progress int, done boolean")

    def forget(self) -> None:
        self.last.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = in_order(rows, ["ts", "event_id"])
        status, progress, done = self.last.get() if self.last.exists() else (None, None, False)
        newest, out = self.last_seen(), []
        for ts, time, event_id, new_status, new_progress in zip(events["ts"], events["time"], events["event_id"], events["status"], events["progress"]):
            late = newest is not None and time < newest
            if late:
                out.append((key[0], ts, event_id, new_status, int(new_progress), True))
                continue
            newest = float(time)
            if done or (new_status, new_progress) == (status, progress):
                continue
            status, progress, done = new_status, int(new_progress), new_status in TERMINAL
            out.append((key[0], ts, event_id, status, progress, False))
        self.last.update((status, progress, done))
        self.remember(newest)
        yield pd.DataFrame(out, columns=["job_id", "ts", "event_id", "status", "progress", "late"])


def job_feed(events: DataFrame, delay: str = "30 seconds", idle: float = 86_400.0) -> DataFrame:
    """Status changes of each job; events that come out of order are told of as ``late``. A job is forgotten when event time has
    passed ``idle`` seconds since its last event."""
    use_rocksdb(events.sparkSession)
    timed = events.withWatermark("ts", delay).withColumn("time", F.unix_micros("ts") / 1e6)
    return timed.groupBy("job_id").transformWithStateInPandas(
        JobFeed(idle), "job_id long, ts timestamp, event_id long, status string, progress int, late boolean", "append", "EventTime"
    )


class EditLog(StatefulProcessor):
    """Accepts a write that expects the current revision. A revision is never forgotten: it is what later writes expect."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "revision int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        writes = in_order(rows, ["seq"])
        current = self.revision.get()[0] if self.revision.exists() else 0
        out = []
        for seq, expected in zip(writes["seq"], writes["expected_revision"]):
            accepted = int(expected) == current
            current += accepted
            out.append((*key, int(seq), accepted, current if accepted else None))
        self.revision.update((int(current),))
        frame = pd.DataFrame(out, columns=["provider", "source_id", "seq", "accepted", "revision"])
        yield frame.astype({"revision": "Int32"})

    def close(self) -> None:
        pass


def edit_log(writes: DataFrame) -> DataFrame:
    """Outcome of each write of a stream ``provider, source_id, seq, expected_revision``."""
    use_rocksdb(writes.sparkSession)
    return writes.groupBy("provider", "source_id").transformWithStateInPandas(
        EditLog(), "provider string, source_id string, seq long, accepted boolean, revision int", "append", "None"
    )
