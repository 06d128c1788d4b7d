"""Values at the very limit of a rule, against the SQL."""

from __future__ import annotations

import pandas as pd
from compare import oracle, rows
from pyspark.sql import functions as F

from lumenfold.plans import registry


def held(tmp_path, sf, name, table: pd.DataFrame) -> str:
    """A folder with one table and, for the rest of the SQL's views, the others as they are."""
    from pathlib import Path

    for p in Path(sf).glob("*.parquet"):
        if p.stem != name:
            (tmp_path / p.name).symlink_to(p)
    table.to_parquet(tmp_path / f"{name}.parquet", index=False)
    return str(tmp_path)


def test_hours_are_rounded_by_what_a_double_holds(spark, sf, tmp_path):
    """Prices whose hours end in five hundredths, which doubles hold exactly, a little above, or a little below."""
    price = [3600.0 * k for k in range(15, 400)] + [3600.0 * k + d for k in range(21, 99, 2) for d in (-0.01, 0.01)]
    at = held(tmp_path, sf, "orders", pd.DataFrame({"o_orderkey": range(len(price)), "o_totalprice": price}))
    got, want = registry.QUERIES["duration_text"](spark, at).toPandas(), oracle(at, registry.SQL["duration_text"])
    assert rows(got) == rows(want)


def test_turns_at_the_limit_are_those_of_the_headings(spark, sf, tmp_path):
    """Poses two seconds apart turn by 60 degrees, just what is too fast: rounding of axes must not decide."""
    n = 720
    ids = [60 * 73 * k + k // 6 * 361 for k in range(n)]
    at = held(tmp_path, sf, "events", pd.DataFrame({"event_id": ids, "user_id": [k // 90 for k in range(n)]}))
    got, want = registry.QUERIES["pose_log"](spark, at), oracle(at, registry.SQL["pose_log"])
    assert got.where(F.col("stable")).count() > 50
    assert rows(got.toPandas()) == rows(want)
