"""Registered queries, grouped by theme."""

import importlib

MODULES = [
    "report_queries",
    "evaluation_queries",
    "signal_queries",
    "model_queries",
    "sweep_queries",
    "stream_queries",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"wavemill.plans.{name}")
