"""The queries and SQL of the operators, one per module."""

from __future__ import annotations

import importlib

MODULES = ["tokens", "lines", "language", "packing", "decontaminate", "suffixes", "jaccard", "quality", "toxicity", "chat", "slack", "manifest", "variants"]


def collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(importlib.import_module(f"flowlens.llm.{name}"), attribute))
    return merged
