"""All queries of the training-data problems, and the SQL of those that SQL can state."""

from __future__ import annotations

from siftline.llm import calibration, capping, languages, leakage, quality, ranking, tokenizing, truncation, varied

MODULES = [capping, varied, ranking, calibration, truncation, languages, tokenizing, leakage, quality]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: f for m in MODULES for k, f in m.SQL.items()}
