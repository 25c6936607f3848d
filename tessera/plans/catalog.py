"""Imports every plan module, which fills the registry."""

from tessera.plans import audit, boxes, docs, evaluate, fitted, flows, models, profile, retrieval, sources  # noqa: F401
from tessera.plans.registry import QUERIES, SQL  # noqa: F401
