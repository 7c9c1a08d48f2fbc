"""Registered queries over the operators of this library."""

from . import crawls, documents, graphs, imports, texts

_PARTS = (graphs, texts, imports, documents, crawls)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
