"""QUERIES and ORACLES of all operators outside the pipeline subpackage."""

from . import build, graph, history, parse, text

PARTS = (history, graph, text, build, parse)
QUERIES: dict = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in PARTS for k, v in part.ORACLES.items()}
