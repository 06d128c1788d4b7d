"""The capture controller: a state machine over one capture's events, and its run on a stream.

`advance` is a pure step, so a log can be replayed in a test, folded in a batch or fed from a stream; a capture
is a key, and captures run side by side.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Meter

#: Fixed values.
DWELL_NS, LOCKOUT_NS = 150_000_000, 250_000_000
BURST_NS, FIRST_FRAME_NS = 12_000_000_000, 4_000_000_000
ATTEMPTS, STORE_FAILURES = 3, 3
DARKER_RUNGS = 4


@dataclass
class Capture:
    """targets: rungs wanted of each direction."""

    targets: dict[str, int] = field(default_factory=dict)
    state: str = "IDLE"
    steady_since: int | None = None
    free_at: int = 0
    burst: int = 0  #: number of the burst in flight, 0 if none
    target: str = ""
    began: int = 0
    got: list[int] = field(default_factory=list)
    shot: list[str] = field(default_factory=list)
    abandoned: list[str] = field(default_factory=list)
    attempts: dict[str, int] = field(default_factory=dict)
    any_frame: bool = False
    bursts: int = 0
    failures: int = 0
    stored: int = 0
    message: str = ""
    metered: dict[str, list[float]] = field(default_factory=dict)  #: low, high, log median, 1 if clipped, of each direction swept
    exposure: float = 0.0  #: what the metering preview is asked for, 0 if nothing yet
    commands: int = 0  #: how often that changed
    clipped: dict[str, float] = field(default_factory=dict)  #: share clipped in the darkest rung of each direction
    darker: dict[str, int] = field(default_factory=dict)  #: rungs added to each direction
    lower_bound: bool = False  #: whether a direction stayed burnt out at the shortest exposure

    def pending(self) -> list[str]:
        return [t for t in self.targets if t not in self.shot and t not in self.abandoned]


def _settle(c: Capture, ok: bool) -> None:
    """The burst in flight ends; a direction is shot, tried again, or given up."""
    if ok:
        c.shot.append(c.target)
    else:
        c.attempts[c.target] = c.attempts.get(c.target, 0) + 1
        if c.attempts[c.target] >= ATTEMPTS:
            if c.any_frame:
                c.abandoned.append(c.target)
            else:
                c.state, c.message = "FAILED", "no frame ever arrived"
    c.burst, c.target, c.got = 0, "", []
    if c.state == "CAPTURING" and not c.pending():
        c.state = "FINISHED"


def _meter(c: Capture, e: dict) -> None:
    """A preview frame of the sweep: low, high, median, clipped, clipped_fraction, high_value, exposure; target if it
    points at one. Statistics unite per direction; an exposure is asked for only where it changes."""
    if e.get("target") is not None:
        low, high, log, burnt = c.metered.get(e["target"], [math.inf, 0.0, math.log(max(e["median"], 1e-12)), 0.0])
        c.metered[e["target"]] = [min(low, e["low"]), max(high, e["high"]), (log + math.log(max(e["median"], 1e-12))) / 2, max(burnt, float(e["clipped"]))]
    m = Meter()
    if e["clipped"] or not m.target_low <= e["high_value"] <= m.target_high:
        if e["clipped"]:
            wanted = e["exposure"] / (8 if e["clipped_fraction"] > 0.2 else 4 if e["clipped_fraction"] > 0.05 else 2)
        else:
            wanted = e["exposure"] * min(m.max_step, max(1 / m.max_step, m.target / max(e["high_value"], 1e-9)))
        if abs(wanted - c.exposure) > 1e-12 * wanted:
            c.exposure, c.commands = wanted, c.commands + 1


def _shoot_again(c: Capture, e: dict) -> bool:
    """Whether a direction that came back burnt out gets a darker rung and is shot again; `darkest` says that it can't."""
    m = Meter()
    share = c.clipped.get(c.target, 0.0)
    if share <= m.clip_tolerance or share < 1 - m.high_percentile:
        return False
    if c.darker.get(c.target, 0) >= DARKER_RUNGS or e.get("darkest"):
        c.lower_bound, c.message = True, "brighter than this camera can read; the top is a lower bound"
        return False
    c.darker[c.target] = c.darker.get(c.target, 0) + 1
    c.targets[c.target] += 1
    c.burst, c.target, c.got = 0, "", []
    return True


def advance(c: Capture, e: dict) -> Capture:
    """One event: kind, now_ns, and by kind burst_id, target, bracket, stable, stored, clipped, fatal."""
    kind, now = e["kind"], e["now_ns"]
    if kind == "scan" and c.state == "IDLE":
        c.state = "SCANNING"
        return c
    if kind == "plan":
        c.targets, c.state = dict(e["targets"]), "CAPTURING"
        return c
    if kind == "resume":
        c.targets, c.shot = dict(e["targets"]), list(e["shot"])
        c.stored = sum(c.targets[t] for t in c.shot)
        c.state = "CAPTURING" if c.pending() else "FINISHED"
        return c
    if kind == "preview" and c.state == "SCANNING":
        _meter(c, e)
        return c
    if c.state != "CAPTURING":
        return c
    if kind == "orientation":
        limit = BURST_NS if c.any_frame else FIRST_FRAME_NS
        if c.burst and now - c.began > limit:
            _settle(c, False)
        if not e.get("stable"):
            c.steady_since = None
            return c
        c.steady_since = now if c.steady_since is None else c.steady_since
        ready = e.get("target") in c.pending() and now - c.steady_since >= DWELL_NS and now >= c.free_at
        if c.state == "CAPTURING" and not c.burst and ready:
            c.bursts += 1
            c.burst, c.target, c.began, c.got = c.bursts, e["target"], now, []
    elif kind == "frame":
        if not c.burst or e.get("burst_id") != c.burst:
            return c  # a straggler of a burst that is over
        c.any_frame = True
        if not e.get("stored", True):
            c.failures += 1
            if c.failures >= STORE_FAILURES:
                c.state, c.message = "FAILED", "frames can't be stored"
            return c
        c.failures = 0
        if e["bracket"] == 0 and "clipped" in e:
            c.clipped[c.target] = e["clipped"]
        if e["bracket"] not in c.got:
            c.got.append(e["bracket"])
            c.stored += 1
    elif kind == "burst_finished" and c.burst and e.get("burst_id") == c.burst:
        whole = len(c.got) >= c.targets[c.target]
        if not (whole and _shoot_again(c, e)):
            _settle(c, whole)
        c.free_at = now + LOCKOUT_NS
    elif kind == "busy" and c.burst:
        c.burst, c.target, c.got, c.free_at = 0, "", [], now + LOCKOUT_NS
    elif kind == "error":
        if e.get("fatal"):
            c.state, c.message = "FAILED", e.get("message", "")
        elif c.burst:
            _settle(c, False)
    return c


def snapshot(c: Capture) -> dict:
    total = len(c.targets)
    return {"state": c.state, "shot": len(c.shot), "abandoned": len(c.abandoned), "stored": c.stored, "bursts": c.bursts, "progress": len(c.shot) / total if total else 1.0}


def replay(events: list[dict]) -> Capture:
    c = Capture()
    for e in events:
        c = advance(c, e)
    return c


SNAPSHOT = "capture string, state string, shot int, abandoned int, stored int, bursts int, progress double"
EVENTS = "capture string, seq long, event string"  #: event: one JSON object


def _fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    c = replay([json.loads(x) for x in pdf.sort_values("seq")["event"]])
    return pd.DataFrame([{"capture": key[0], **snapshot(c)}])


def fold(events: DataFrame) -> DataFrame:
    """The last snapshot of each capture of a finished log; a capture's events are one task's."""
    return events.groupBy("capture").applyInPandas(_fold, SNAPSHOT)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    c = Capture(**json.loads(state.get[0])) if state.exists else Capture()
    rows = pd.concat(list(batches)).sort_values("seq")
    for x in rows["event"]:
        c = advance(c, json.loads(x))
    state.update((json.dumps(asdict(c)),))
    yield pd.DataFrame([{"capture": key[0], **snapshot(c)}])


def run(events: DataFrame) -> DataFrame:
    """The same on a stream: a snapshot of each capture after every batch that brings it events."""
    return events.groupBy("capture").applyInPandasWithState(_step, SNAPSHOT, "state string", "Update", GroupStateTimeout.NoTimeout)
