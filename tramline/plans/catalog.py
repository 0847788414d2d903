"""All checked queries; importing the check modules fills the registry."""

import importlib

from tramline.plans.registry import ORACLE, QUERIES

for _module in ("network_checks", "demand_checks", "profile_checks", "match_checks", "source_checks", "stream_checks", "model_checks"):
    importlib.import_module(f"tramline.plans.{_module}")

__all__ = ["ORACLE", "QUERIES"]
