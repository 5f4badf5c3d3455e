"""Registered queries of the library: ``QUERIES`` by name and ``ORACLES``, their DuckDB SQL."""

from __future__ import annotations

from . import analysis, evaluate, flows, gateways, graph, sources, tagging, trainset

_PARTS = (sources, tagging, flows, graph, gateways, evaluate, trainset, analysis)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: f for part in _PARTS for name, f in part.ORACLES.items()}
