"""Runnable queries over a folder of tables."""

from meterstone.plans import (  # noqa: F401
    governance_queries, limit_queries, security_queries, streaming_queries, usage_queries, workflow_queries,
)
from meterstone.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
