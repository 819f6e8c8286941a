"""Registered queries and their oracle SQL."""

from docloom.plans import core, lifecycle, media, more, policy
from docloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "core", "lifecycle", "media", "more", "policy"]
