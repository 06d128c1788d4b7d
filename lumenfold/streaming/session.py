"""A capture from sweep to last burst on a stream, in typed state: directions in a map, the ladder beside them.

Preview frames are credited to the direction that the pose comes nearest to within a cone; a direction that comes back
burnt out extends the ladder and is shot again; a timer ends a burst whose camera has fallen silent. `step` is pure, so the
same log can be folded in a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Meter
from ..operators.capture import grow
from .controller import ATTEMPTS, BURST_NS, DARKER_RUNGS, DWELL_NS, FIRST_FRAME_NS, LOCKOUT_NS, STORE_FAILURES

MS = 1_000_000
EPOCH_MS = 946_684_800_000  #: event time of a device clock's zero: a stream takes the years before it for late
EVENTS = (
    "capture string, seq long, now_ns long, kind string, x double, y double, z double, stable boolean, burst_id long, bracket int, stored boolean, clipped double, low double, high double, median double, high_value double, exposure double"
)  # kinds: scan, preview, plan, orientation, frame, burst_finished, busy, error; x..z: where the camera looks
SNAPSHOT = "capture string, state string, shot int, abandoned int, stored int, bursts int, metered int, low double, high double, exposure double, commands int, rungs int, darkest double, added int, lower_bound boolean, message string"
CORE = "state string, steady_since long, free_at long, burst long, target int, began long, got array<int>, wanted int, bursts long, any_frame boolean, failures int, stored int, exposure double, commands int, clipped double, lower_bound boolean, message string, pose array<double>, ladder array<double>"
DIRECTION = "low double, high double, log_median double, burnt boolean, first int, last int, darker int, attempts int, state string"


@dataclass(frozen=True)
class Plan:
    """What all captures of a stream share: directions (unit vectors), first ladder and run, how short and long an exposure can be."""

    directions: tuple[tuple[float, float, float], ...]
    ladder: tuple[float, ...] = (2.0**-6, 2.0**-3, 1.0)
    run: tuple[int, int] = (1, 2)
    shortest: float = 1e-4
    longest: float = 16.0
    ev_step: float = 3.0
    most: int = 9
    cone_deg: float = 25.0

    def realised(self, exposure: float) -> float:
        return min(self.longest, max(self.shortest, exposure))


@dataclass
class Direction:
    low: float = math.inf
    high: float = 0.0
    log_median: float | None = None
    burnt: bool = False
    first: int = 0
    last: int = -1
    darker: int = 0
    attempts: int = 0
    state: str = "PENDING"


@dataclass
class Session:
    state: str = "IDLE"
    steady_since: int | None = None
    free_at: int = 0
    burst: int = 0
    target: int = -1
    began: int = 0
    got: list[int] = field(default_factory=list)
    wanted: int = 0
    bursts: int = 0
    any_frame: bool = False
    failures: int = 0
    stored: int = 0
    exposure: float = 0.0
    commands: int = 0
    clipped: float = 0.0
    lower_bound: bool = False
    message: str = ""
    pose: list[float] | None = None
    ladder: list[float] = field(default_factory=list)
    directions: dict[int, Direction] = field(default_factory=dict)

    def at(self, k: int) -> Direction:
        return self.directions.setdefault(k, Direction())


def step_down(share: float) -> float:
    """How much shorter to expose where this share of a frame is burnt out."""
    return 8.0 if share > 0.2 else 4.0 if share > 0.05 else 2.0


def burnt_out(share: float, m: Meter = Meter()) -> bool:
    return share > m.clip_tolerance and share >= 1 - m.high_percentile


def nearest(pose: list[float] | None, plan: Plan, cone_deg: float) -> int:
    """The direction that a pose looks nearest to, if within the cone, else -1."""
    if pose is None:
        return -1
    size = math.sqrt(sum(c * c for c in pose)) or 1.0
    cosines = [sum(a * b for a, b in zip(pose, d, strict=True)) / size for d in plan.directions]
    best = max(range(len(cosines)), key=cosines.__getitem__, default=-1)
    return best if best >= 0 and cosines[best] >= math.cos(math.radians(cone_deg)) else -1


def _preview(s: Session, e: dict, plan: Plan, m: Meter = Meter()) -> None:
    """Statistics unite with those of the direction that the pose is near; another exposure is asked for only where it differs."""
    k = nearest(s.pose, plan, plan.cone_deg)
    clipped = burnt_out(e["clipped"] or 0.0)
    if k >= 0:
        d, log = s.at(k), math.log(max(e["median"], 1e-12))
        d.low, d.high, d.burnt = min(d.low, e["low"]), max(d.high, e["high"]), d.burnt or clipped
        d.log_median = log if d.log_median is None else (d.log_median + log) / 2
    if clipped:
        wanted = e["exposure"] / step_down(e["clipped"])
    elif not m.target_low <= e["high_value"] <= m.target_high:
        wanted = e["exposure"] * min(m.max_step, max(1 / m.max_step, m.target / max(e["high_value"], 1e-9)))
    else:
        return
    wanted = plan.realised(wanted)
    if wanted != s.exposure:
        s.exposure, s.commands = wanted, s.commands + 1


def _end(s: Session, ok: bool, plan: Plan) -> None:
    """The burst in flight ends: its direction is shot, waits for another try, or is given up."""
    d = s.at(s.target)
    if ok:
        d.state = "SHOT"
    else:
        d.attempts += 1
        if d.attempts >= ATTEMPTS and s.any_frame:
            d.state = "ABANDONED"
        elif d.attempts >= ATTEMPTS:
            s.state, s.message = "FAILED", "the camera sent no frame"
    s.burst, s.target, s.got = 0, -1, []
    if s.state == "CAPTURING" and all(s.at(k).state != "PENDING" for k in range(len(plan.directions))):
        s.state = "FINISHED"


def _extended(s: Session, plan: Plan) -> bool:
    """Whether the direction just shot was burnt out and its run now reaches darker: then it is shot again."""
    if not burnt_out(s.clipped):
        return False
    d, n = s.at(s.target), len(plan.directions)
    grown = None
    if d.darker < DARKER_RUNGS:
        wanted = s.ladder[d.first] / step_down(s.clipped)
        grown = grow(s.ladder, {k: (s.at(k).first, s.at(k).last) for k in range(n)}, s.target, wanted, plan.realised, plan.ev_step, plan.most)
    if grown is None:
        s.lower_bound, s.message = True, f"direction {s.target} exceeds the range of this camera; its maximum may be higher"
        return False
    s.ladder, runs = grown
    for k, (first, last) in runs.items():
        s.at(k).first, s.at(k).last = first, last
    d.darker += 1
    s.burst, s.target, s.got = 0, -1, []
    return True


def limit(s: Session) -> int:
    """When the burst in flight is given up."""
    return s.began + (BURST_NS if s.any_frame else FIRST_FRAME_NS)


def expire(s: Session, now: int, plan: Plan) -> None:
    if s.state == "CAPTURING" and s.burst and now > limit(s):
        _end(s, False, plan)


def step(s: Session, e: dict, plan: Plan) -> Session:
    kind, now = e["kind"], e["now_ns"]
    if e.get("x") is not None:
        s.pose = [e["x"], e["y"], e["z"]]
    if kind == "scan" and s.state == "IDLE":
        s.state = "SCANNING"
    elif kind == "preview" and s.state == "SCANNING":
        _preview(s, e, plan)
    elif kind == "plan" and s.state in ("IDLE", "SCANNING"):
        s.state, s.ladder = "CAPTURING", list(plan.ladder)
        for k in range(len(plan.directions)):
            s.at(k).first, s.at(k).last = plan.run
    elif s.state != "CAPTURING":
        return s
    elif kind == "orientation":
        expire(s, now, plan)
        if not e["stable"]:
            s.steady_since = None
            return s
        s.steady_since = now if s.steady_since is None else s.steady_since
        k = nearest(s.pose, plan, plan.cone_deg)
        if s.state == "CAPTURING" and not s.burst and k >= 0 and s.at(k).state == "PENDING" and now - s.steady_since >= DWELL_NS and now >= s.free_at:
            s.bursts += 1
            s.burst, s.target, s.began, s.got, s.clipped = s.bursts, k, now, [], 0.0
            s.wanted = s.at(k).last - s.at(k).first + 1
    elif kind == "frame" and s.burst and e["burst_id"] == s.burst:
        s.any_frame = True
        if e.get("stored") is False:
            s.failures += 1
            if s.failures >= STORE_FAILURES:
                s.state, s.message = "FAILED", "storing frames kept failing"
            return s
        s.failures = 0
        if e["bracket"] == 0 and e.get("clipped") is not None:
            s.clipped = e["clipped"]
        if e["bracket"] not in s.got:
            s.got.append(e["bracket"])
            s.stored += 1
    elif kind == "burst_finished" and s.burst and e["burst_id"] == s.burst:
        whole = len(s.got) >= s.wanted
        if not (whole and _extended(s, plan)):
            _end(s, whole, plan)
        s.free_at = now + LOCKOUT_NS
    elif kind == "busy" and s.burst:
        s.burst, s.target, s.got, s.free_at = 0, -1, [], now + LOCKOUT_NS
    elif kind == "error" and s.burst:
        _end(s, False, plan)
    return s


def snapshot(capture: str, s: Session) -> dict:
    metered = [d for d in s.directions.values() if d.log_median is not None]
    count = lambda state: sum(d.state == state for d in s.directions.values())
    return {
        "capture": capture, "state": s.state, "shot": count("SHOT"), "abandoned": count("ABANDONED"), "stored": s.stored, "bursts": s.bursts, "metered": len(metered), "low": min((d.low for d in metered), default=None),
        "high": max((d.high for d in metered), default=None), "exposure": s.exposure, "commands": s.commands, "rungs": len(s.ladder), "darkest": s.ladder[0] if s.ladder else None,
        "added": sum(d.darker for d in s.directions.values()), "lower_bound": s.lower_bound, "message": s.message,
    }


def _records(pdf: pd.DataFrame) -> list[dict]:
    return pdf.astype(object).where(pdf.notna(), None).sort_values("seq").to_dict("records")


TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _folded(plan: Plan):
    """Events sorted by capture and seq, a batch at a time -> snapshots; one session is held."""
    schema = pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in SNAPSHOT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, None
        for batch in batches:
            known = [pc.if_else(pc.is_nan(c), pa.scalar(None, c.type), c) if pa.types.is_floating(c.type) else c for c in batch.columns]
            done = []
            for e in pa.RecordBatch.from_arrays(known, names=batch.schema.names).to_pylist():
                if s is None or e["capture"] != at:
                    if s is not None:
                        done.append(snapshot(at, s))
                    at, s = e["capture"], Session()
                s = step(s, e, plan)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if s is not None:
            yield pa.RecordBatch.from_pylist([snapshot(at, s)], schema=schema)

    return run


def fold(events: DataFrame, plan: Plan) -> DataFrame:
    """The last snapshot of each capture of a finished log, as of its events alone; a capture's events are one task's, which
    reads those of its captures one after the other, without a call for each."""
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a step costs more than its bytes tell
    return events.repartition(tasks, "capture").sortWithinPartitions("capture", "seq").mapInArrow(_folded(plan), SNAPSHOT)


class Captures(StatefulProcessor):
    """One capture a key: its core in a value, its directions in a map, and one timer for the burst in flight."""

    def __init__(self, plan: Plan):
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", CORE)
        self.directions = handle.getMapState("directions", "direction int", DIRECTION)

    def _load(self) -> Session:
        if not self.core.exists():
            return Session()
        s = Session(**dict(zip([f.name for f in fields(Session)][:-1], self.core.get(), strict=True)))
        s.got, s.ladder, s.pose = list(s.got), list(s.ladder), None if s.pose is None else list(s.pose)
        s.directions = {k[0]: Direction(*v) for k, v in self.directions.iterator()}
        return s

    def _save(self, s: Session, before: dict[int, Direction]) -> None:
        """Only directions that changed are written."""
        values = asdict(s)
        self.core.update(tuple(values[f.name] for f in fields(Session)[:-1]))
        for k, d in s.directions.items():
            if before.get(k) != d:
                self.directions.updateValue((k,), tuple(asdict(d).values()))
        due = EPOCH_MS + limit(s) // MS + 1 if s.state == "CAPTURING" and s.burst else None
        for t in list(self.handle.listTimers()):
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load()
        before = {k: Direction(**asdict(d)) for k, d in s.directions.items()}
        for e in _records(pd.concat(list(rows))):
            s = step(s, e, self.plan)
        self._save(s, before)
        yield pd.DataFrame([snapshot(key[0], s)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load()
        before = {k: Direction(**asdict(d)) for k, d in s.directions.items()}
        expire(s, (expiredTimerInfo.getExpiryTimeInMs() - EPOCH_MS) * MS, self.plan)
        self._save(s, before)
        yield pd.DataFrame([snapshot(key[0], s)])

    def close(self) -> None:
        pass


def run(events: DataFrame, plan: Plan, late: str = "5 seconds") -> DataFrame:
    """The same on a stream of EVENTS: a snapshot of each capture after a batch that brings it events, or whose watermark
    passes its burst's limit. The session needs the RocksDB state store."""
    timed = events.selectExpr("*", f"timestamp_micros(now_ns div 1000 + {EPOCH_MS}000) as at").withWatermark("at", late)
    return timed.groupBy("capture").transformWithStateInPandas(Captures(plan), SNAPSHOT, "Update", "EventTime")
