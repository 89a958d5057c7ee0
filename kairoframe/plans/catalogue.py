"""Registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import datasets, evaluation, extras, notes, poses, reporting, scaled, signal

_MODULES = (signal, scaled, evaluation, reporting, datasets, poses, extras, notes)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = signal.rally_rollup
