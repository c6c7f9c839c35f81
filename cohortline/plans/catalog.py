"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = (
    "counting",
    "timelines",
    "hospital",
    "icu",
    "followup",
    "metrics",
    "tables",
    "sampling",
    "files",
)


def register() -> None:
    for module in MODULES:
        importlib.import_module(f"cohortline.plans.{module}")
