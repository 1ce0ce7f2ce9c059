"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from chorus.plans import q_aggregate, q_checks, q_eval, q_io, q_ml, q_relational, q_text, q_trainers, q_vectors  # noqa: F401
from chorus.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
