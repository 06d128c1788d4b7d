"""All queries of the reference's operators and their SQL."""

from __future__ import annotations

from . import capture, devices, exposure, formats, lens, scene, stream

MODULES = (exposure, scene, devices, formats, capture, lens, stream)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
