"""Images and their metadata, paired by timestamp as they arrive.

What arrives waits for its other half; a second arrival of the same half takes the place of the first, and beyond a bound
the oldest of a side is forgotten: a camera that loses results must not fill the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST = 32  #: images, and results, that wait at a camera
ARRIVALS = "camera string, seq long, stamp long, side string, value long"  #: side: image or meta
PAIRS = "camera string, stamp long, image long, meta long"


def step(waiting: dict[str, dict[int, int]], e: dict, most: int = MOST) -> tuple[int, int, int] | None:
    """One arrival; the pair (stamp, image, meta) that it completes, if it does."""
    side, stamp = e["side"], e["stamp"]
    own, other = waiting[side], waiting["meta" if side == "image" else "image"]
    if stamp in other:
        half = other.pop(stamp)
        return (stamp, e["value"], half) if side == "image" else (stamp, half, e["value"])
    own[stamp] = e["value"]
    if len(own) > most:
        del own[min(own)]
    return None


def _pairs(camera: str, waiting: dict, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    found = [step(waiting, e, most) for e in rows.sort_values("seq").to_dict("records")]
    return pd.DataFrame([(camera, *p) for p in found if p], columns=["camera", "stamp", "image", "meta"])


def _in_order(most: int):
    """Arrivals sorted by camera and seq, a batch at a time; only what waits at one camera is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, {"image": {}, "meta": {}}
        for batch in batches:
            found = []
            for camera, stamp, side, value in zip(*[batch.column(n).to_pylist() for n in ("camera", "stamp", "side", "value")], strict=True):
                if camera != at:
                    at, waiting = camera, {"image": {}, "meta": {}}
                if p := step(waiting, {"side": side, "stamp": stamp, "value": value}, most):
                    found.append((camera, *p))
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["camera", "stamp", "image", "meta"])

    return run


def pair(arrivals: DataFrame, most: int = MOST) -> DataFrame:
    """ARRIVALS of finished captures -> PAIRS, camera by camera in the order of arrival; a camera's arrivals are one task's,
    which reads them sorted and holds a batch of them."""
    tasks = int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a step costs more than its bytes tell
    return arrivals.repartition(tasks, "camera").sortWithinPartitions("camera", "seq").mapInArrow(_in_order(most), PAIRS)


class Pairing(StatefulProcessor):
    """What waits at a camera, by side and stamp: at most twice the bound."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "side string, stamp long", "value long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = {tuple(k): v[0] for k, v in self.waiting.iterator()}
        waiting: dict[str, dict[int, int]] = {"image": {}, "meta": {}}
        for (side, stamp), value in before.items():
            waiting[side][stamp] = value
        out = _pairs(key[0], waiting, pd.concat(list(rows)), self.most)
        after = {(side, stamp): value for side, held in waiting.items() for stamp, value in held.items()}
        for k in before.keys() - after.keys():
            self.waiting.removeKey(k)
        for k, value in after.items():
            if before.get(k) != value:
                self.waiting.updateValue(k, (int(value),))
        yield out

    def close(self) -> None:
        pass


def run(arrivals: DataFrame, most: int = MOST) -> DataFrame:
    """The same on a stream: pairs as they are completed. The session needs the RocksDB state store."""
    return arrivals.groupBy("camera").transformWithStateInPandas(Pairing(most), PAIRS, "Append", "None")
