"""Small seam problems, solved side by side, against one after the other."""

from __future__ import annotations

import numpy as np

from lumenfold.config import Seam
from lumenfold.operators import composite, cut


def test_many_small_seams_equal_one_by_one(spark, monkeypatch):
    """Grids of up to 4 x 3 pixels, two to four labels, samples that are missing, pixels without any."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    cfg, width, height = Seam(smoothness=1.0), 4, 3
    edges = composite._seam_edges(width, height, True)
    for key in range(60):
        n = 2 + key % 3
        value, weight = rng.normal(size=(12, n)), rng.uniform(0, 2, (12, n))
        gone = rng.random((12, n)) < 0.15
        gone[0, n - 1] = False  # the last label is named
        value[gone], weight[gone] = np.nan, np.nan
        rows += [(key, p, k, float(value[p, k]), float(weight[p, k])) for p in range(12) for k in range(n) if not gone[p, k]]
        labels = cut.label_seams(value, np.where(np.isnan(weight).all(axis=1, keepdims=True), np.nan, weight), edges, cfg)
        want[key] = labels.tolist(), cut.energy(labels, value, weight, edges, cfg)
    monkeypatch.setattr(cut, "label_seams", None)  # a call a problem is what took the time
    df = spark.createDataFrame(rows, "key long, pixel int, label int, log_value double, weight double")
    out = composite.solved_seams(df, "key", width, height, cfg=cfg)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["key"]: (r["labels"], r["energy"]) for r in out.collect()}
    assert got.keys() == want.keys() and sum(got[k][0] == want[k][0] for k in want) == 60
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
