"""Registered queries by area. Importing this package fills the registry."""

from riskframe.plans import activity, cases, code, findings, graph, licenses, scripts, store, streams, text, upgrades, watch  # noqa: F401
from riskframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
