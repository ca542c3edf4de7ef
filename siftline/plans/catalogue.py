"""All queries of the reference operators with the SQL that they must equal."""

from __future__ import annotations

import importlib.util

from siftline.plans import audit_queries  # noqa: F401
from siftline.plans.views import QUERIES, SQL

for _name in ("metric_queries", "pipeline_queries", "report_queries"):
    if importlib.util.find_spec(f"siftline.plans.{_name}"):
        importlib.import_module(f"siftline.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
