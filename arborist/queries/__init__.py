"""Registered queries over the XML views of the test tables, with their SQL equivalents."""

from __future__ import annotations

from arborist.queries import axes, functions, joins, rules, schemas, sequences

MODULES = (axes, joins, sequences, functions, rules, schemas)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}
