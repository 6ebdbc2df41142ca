"""Registered queries; importing this package fills the registry."""

from kgspark.plans import code, documents, events, graph, ingest, notes, resolution, store, streaming, web, writes  # noqa: F401
from kgspark.plans.base import ORACLES, QUERIES  # noqa: F401
