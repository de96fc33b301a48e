"""Queries over the driver tables and their SQL twins."""

from __future__ import annotations

from importlib import import_module

_THEMES = ("extraction", "texts", "datasets", "retrieval", "evaluation", "trainlogs", "files")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for theme in _THEMES:
        out.update(getattr(import_module(f"docloom.registry.{theme}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
