"""A capture's typed state: steps by hand, the stream against the fold, a burst that a timer ends."""

from __future__ import annotations

import math

import pytest

from lumenfold.plans import stream
from lumenfold.streaming import session as k

AHEAD, RIGHT = (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)
PLAN = k.Plan(directions=(AHEAD, RIGHT))
NONE = dict.fromkeys([c.split()[0] for c in k.EVENTS.split(", ")])


def event(kind: str, ms: int, look=None, **more) -> dict:
    return {**NONE, "kind": kind, "now_ns": ms * k.MS, **(dict(zip("xyz", look, strict=True)) if look else {}), **more}


def turned(deg: float):
    return (math.sin(math.radians(deg)), 0.0, math.cos(math.radians(deg)))


def preview(ms: int, look, clipped=0.0, high_value=0.6) -> dict:
    return event("preview", ms, look, clipped=clipped, low=0.1, high=2.0, median=0.5, high_value=high_value, exposure=0.25)


def burst(ms: int, look, number: int, rungs: int, clipped=0.0) -> list[dict]:
    aim = [event("orientation", ms + t, look, stable=True) for t in (0, 200)]
    return [*aim, *[event("frame", ms + 210, burst_id=number, bracket=b, stored=True, clipped=clipped) for b in range(rungs)], event("burst_finished", ms + 300, burst_id=number)]


def replay(events: list[dict], plan: k.Plan = PLAN) -> k.Session:
    s = k.Session()
    for e in events:
        s = k.step(s, e, plan)
    return s


START = [event("scan", 0), event("plan", 10)]


def test_previews_find_their_direction():
    s = replay([event("scan", 0), preview(1, turned(20)), preview(2, turned(26)), preview(3, turned(80), clipped=0.1), preview(4, turned(70), high_value=0.1)])
    assert {d: x.log_median is not None for d, x in s.directions.items()} == {0: True, 1: True} and s.directions[1].burnt and not s.directions[0].burnt
    assert s.exposure == pytest.approx(0.25 * 0.6 / 0.1) and s.commands == 2


def test_a_burnt_direction_reaches_darker_and_is_shot_again():
    s = replay([*START, *burst(1000, AHEAD, 1, 2, clipped=0.3)])
    assert s.directions[0].state == "PENDING" and s.directions[0].first == 0 and len(s.ladder) == 3  # a rung of the ladder is taken first
    s = replay([*START, *burst(1000, AHEAD, 1, 2, 0.3), *burst(3000, AHEAD, 2, 3, 0.3)])
    assert s.ladder[0] == 2.0**-9 and len(s.ladder) == 4 and s.directions[1].first == 2  # then one is added, and the others' runs follow
    s = replay([*START, *burst(1000, AHEAD, 1, 2, 0.3), *burst(3000, AHEAD, 2, 3, 0.3), *burst(5000, AHEAD, 3, 4)])
    assert s.directions[0].state == "SHOT" and s.wanted == 4 and not s.lower_bound


def test_the_shortest_exposure_is_a_lower_bound():
    tight = k.Plan(directions=(AHEAD, RIGHT), shortest=2.0**-6, run=(0, 2))
    s = replay([*START, *burst(1000, AHEAD, 1, 3, 0.3)], tight)
    assert s.lower_bound and s.directions[0].state == "SHOT" and s.ladder == list(tight.ladder)


def test_a_silent_burst_expires():
    s = replay([*START, *burst(1000, AHEAD, 1, 2)[:2]])
    k.expire(s, s.began + 3_000 * k.MS, PLAN)
    assert s.burst == 1
    k.expire(s, k.limit(s) + 1, PLAN)
    assert s.burst == 0 and s.directions[0].attempts == 1 and s.state == "CAPTURING"


def test_stream_equals_fold(spark, sf, tmp_path):
    """Two batches, the second from a restarted query; then a burst that only the watermark ends."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = stream.capture_events(spark, sf).where("capture in ('1', '2', '5', '7')").cache()
    want = {r["capture"]: r for r in k.fold(log, stream.PLAN).collect()}
    assert sum(r["added"] for r in want.values()) > 0 and {r["state"] for r in want.values()} & {"FINISHED", "CAPTURING"}
    half = log.selectExpr("percentile_approx(now_ns, 0.5)").first()[0]
    got: dict = {}

    def run_on(part):
        log.where(part).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        source = spark.readStream.schema(k.EVENTS).json(f"{tmp_path}/in")
        q = k.run(source, stream.PLAN, "10 days").writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({r["capture"]: r for r in df.collect()}))
        q = q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None

    run_on(f"now_ns <= {half}")
    run_on(f"now_ns > {half}")
    assert got == want


def test_a_timer_ends_a_silent_burst(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [c.split()[0] for c in k.EVENTS.split(", ")]
    got: list = []

    def run_on(events, capture):
        rows = [tuple({**e, "capture": capture, "seq": i}[n] for n in names) for i, e in enumerate(events)]
        spark.createDataFrame(rows, k.EVENTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        source = spark.readStream.schema(k.EVENTS).json(f"{tmp_path}/in")
        q = k.run(source, PLAN, "1 second").writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect()))
        q = q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None

    run_on([*START, *burst(1000, AHEAD, 1, 2), *burst(3000, RIGHT, 2, 2)[:2]], "silent")
    run_on([event("scan", 60_000)], "other")
    run_on([event("scan", 120_000)], "third")
    last = [r for r in got if r["capture"] == "silent"]
    assert last[0]["bursts"] == 2 and len(last) > 1 and last[-1]["shot"] == 1 and last[-1]["state"] == "CAPTURING"


def test_pairs_of_a_stream_are_those_of_the_batch(spark, sf, tmp_path):
    from lumenfold.plans.scene import arrivals
    from lumenfold.streaming import pairing

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = arrivals(spark, sf).cache()
    want = sorted(map(tuple, pairing.pair(log, 3).collect()))
    got: list = []
    for part in ("seq < 400", "seq >= 400"):
        log.where(part).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = pairing.run(spark.readStream.schema(pairing.ARRIVALS).json(f"{tmp_path}/in"), 3).writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
        q = q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
    assert sorted(got) == want and len(want) > 50


def test_the_last_of_a_side_waits_and_the_oldest_goes():
    from lumenfold.streaming import pairing

    waiting = {"image": {}, "meta": {}}
    arrive = lambda side, stamp, value: pairing.step(waiting, {"side": side, "stamp": stamp, "value": value}, 2)
    assert [arrive("image", 5, 1), arrive("image", 5, 2), arrive("meta", 5, 9)] == [None, None, (5, 2, 9)]
    assert [arrive("meta", s, s) for s in (7, 3, 8)] == [None] * 3 and sorted(waiting["meta"]) == [7, 8]
    assert arrive("image", 3, 4) is None and arrive("image", 7, 6) == (7, 6, 7)
