"""Example queries over the driver tables, each with its SQL oracle."""

import importlib

MODULES = ("tables", "mapping", "intake", "changes", "linking", "training", "ledger", "drift", "reports", "streams")


def load() -> None:
    """Imports every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"flowlink.plans.{name}")
