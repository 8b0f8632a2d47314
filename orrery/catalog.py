"""Name to (query, SQL twin) of every operator outside the language-model subpackage."""

from __future__ import annotations

from orrery.plans import answers, bundles, checks, events, folds, handoff, joins, measuring, orders, passages, planning, ranking, selection, spans, stateful, stores, text  # noqa: F401  they register
from orrery.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
