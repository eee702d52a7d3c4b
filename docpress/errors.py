"""Errors raised by the library."""

from __future__ import annotations


class DuplicateKeyError(ValueError):
    """A strict unique append met keys that were already taken."""


class QualityGateError(ValueError):
    """A collection did not pass its quality gate."""


class ScratchLocationError(RuntimeError):
    """No folder that every executor can reach is known."""
