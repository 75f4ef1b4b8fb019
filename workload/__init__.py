"""Registered queries, the tables they read and their SQL twins."""

import importlib

MODULES = ["panel", "eda", "models", "pages"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
