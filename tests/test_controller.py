from __future__ import annotations

import json

from lumenfold.streaming import controller as k

MS = 1_000_000


def burst(seq_ns: int, target: str, burst_id: int, rungs: int) -> list[dict]:
    return [
        {"kind": "orientation", "now_ns": seq_ns, "stable": True, "target": target},
        {"kind": "orientation", "now_ns": seq_ns + 200 * MS, "stable": True, "target": target},
        *[{"kind": "frame", "now_ns": seq_ns + 210 * MS, "burst_id": burst_id, "bracket": b} for b in range(rungs)],
        {"kind": "burst_finished", "now_ns": seq_ns + 300 * MS, "burst_id": burst_id},
    ]


PLAN = {"kind": "plan", "now_ns": 0, "targets": {"a": 3, "b": 2}}
WHOLE = [PLAN, *burst(1000 * MS, "a", 1, 3), *burst(3000 * MS, "b", 2, 2)]


def test_a_whole_capture():
    s = k.snapshot(k.replay(WHOLE))
    assert s == {"state": "FINISHED", "shot": 2, "abandoned": 0, "stored": 5, "bursts": 2, "progress": 1.0}


def test_stragglers_and_repeats_are_dropped():
    late = {"kind": "frame", "now_ns": 9, "burst_id": 7, "bracket": 0}
    again = [x for e in WHOLE for x in ((e, e) if e["kind"] == "frame" else (e,))]
    assert k.snapshot(k.replay([*again[:3], late, *again[3:]]))["stored"] == 5


def test_timeouts_abandon_or_fail():
    wait = lambda t, c: [{"kind": "orientation", "now_ns": c * 20_000 * MS + d * MS, "stable": True, "target": t} for d in (0, 200)]
    never = k.replay([PLAN, *[e for c in range(1, 6) for e in wait("a", c)]])
    assert never.state == "FAILED"
    some = k.replay([PLAN, *burst(1000 * MS, "b", 1, 2), *[e for c in range(1, 6) for e in wait("a", c)]])
    assert some.state == "FINISHED" and some.abandoned == ["a"] and some.shot == ["b"]


def test_busy_costs_no_attempt_and_store_failures_end():
    c = k.replay([PLAN, *WHOLE[1:3], {"kind": "busy", "now_ns": 1300 * MS}])
    assert not c.burst and not c.attempts
    bad = [{"kind": "frame", "now_ns": 1, "burst_id": 1, "bracket": b, "stored": False} for b in range(3)]
    assert k.replay([PLAN, *WHOLE[1:3], *bad]).state == "FAILED"


def test_stream_equals_fold(spark, tmp_path):
    rows = [(c, i, json.dumps(e)) for c in ("one", "two") for i, e in enumerate(WHOLE if c == "one" else WHOLE[:6])]
    want = {r["capture"]: r.asDict() for r in k.fold(spark.createDataFrame(rows, k.EVENTS)).collect()}
    for part, (a, b) in enumerate(((0, 7), (7, 99))):
        spark.createDataFrame(rows[a:b], k.EVENTS).coalesce(1).write.json(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(k.EVENTS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    got: dict = {}
    q = k.run(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({r["capture"]: r.asDict() for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got == want and want["one"]["state"] == "FINISHED"


def test_a_burnt_out_direction_is_shot_again_darker():
    def shot(ns, burst_id, rungs, clipped, **more):
        return [
            {"kind": "orientation", "now_ns": ns, "stable": True, "target": "a"},
            {"kind": "orientation", "now_ns": ns + 200 * MS, "stable": True, "target": "a"},
            *[{"kind": "frame", "now_ns": ns + 210 * MS, "burst_id": burst_id, "bracket": b, "clipped": clipped} for b in range(rungs)],
            {"kind": "burst_finished", "now_ns": ns + 300 * MS, "burst_id": burst_id, **more},
        ]

    plan = {"kind": "plan", "now_ns": 0, "targets": {"a": 2}}
    grown = k.replay([plan, *shot(1000 * MS, 1, 2, 0.3)])
    assert grown.state == "CAPTURING" and grown.targets == {"a": 3} and grown.attempts == {} and grown.shot == []
    done = k.replay([plan, *shot(1000 * MS, 1, 2, 0.3), *shot(3000 * MS, 2, 3, 0.0)])
    assert done.state == "FINISHED" and done.shot == ["a"] and not done.lower_bound
    stuck = k.replay([plan, *shot(1000 * MS, 1, 2, 0.3, darkest=True)])
    assert stuck.state == "FINISHED" and stuck.shot == ["a"] and stuck.lower_bound
    many = [plan, *[e for n in range(6) for e in shot((1000 + 2000 * n) * MS, n + 1, 2 + n, 0.3)]]
    assert k.replay(many).darker == {"a": k.DARKER_RUNGS} and k.replay(many).lower_bound


def test_sweep_and_resume():
    seen = {"kind": "preview", "now_ns": 1, "target": "a", "low": 0.1, "high": 2.0, "median": 0.5, "clipped": True, "clipped_fraction": 0.1, "high_value": 1.0, "exposure": 0.04}
    scan = [{"kind": "scan", "now_ns": 0}, seen, {**seen, "clipped": False, "high_value": 0.5, "high": 9.0}, {**seen, "target": None}]
    c = k.replay(scan)
    assert c.state == "SCANNING" and c.metered["a"][:2] == [0.1, 9.0] and c.metered["a"][3] == 1.0
    assert c.exposure == 0.01 and c.commands == 1  # asked for once, though two frames want it
    assert k.replay([{**seen}]).metered == {}
    assert k.replay([*scan, PLAN]).state == "CAPTURING"
    r = k.replay([{"kind": "resume", "now_ns": 0, "targets": {"a": 3, "b": 2}, "shot": ["a"]}])
    assert r.state == "CAPTURING" and r.stored == 3 and r.pending() == ["b"]
    assert k.replay([{"kind": "resume", "now_ns": 0, "targets": {"a": 3}, "shot": ["a"]}]).state == "FINISHED"
