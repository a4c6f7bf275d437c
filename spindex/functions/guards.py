"""Argument checks; every refusal is a ValueError raised before a plan is built."""

from __future__ import annotations

import math

SAFE_INT = (1 << 53) - 1


def stored_key(key: object) -> object:
    """A key that may be stored or looked up: a finite number or a string."""
    if isinstance(key, bool) or not isinstance(key, (int, float, str)):
        raise ValueError(f"a key must be a number or a string, not {type(key).__name__}")
    if isinstance(key, float) and not math.isfinite(key):
        raise ValueError("a numeric key must be finite")
    if isinstance(key, int) and abs(key) > SAFE_INT:
        raise ValueError("an integer key must lie within 2**53 - 1 of zero")
    return key


def bound_key(key: object) -> object:
    """A range bound: infinities are allowed, NaN isn't."""
    if isinstance(key, float) and math.isnan(key):
        raise ValueError("a bound can't be NaN")
    return key if isinstance(key, float) and math.isinf(key) else stored_key(key)


def no_nan(*values: float) -> None:
    """Spatial arguments; NaN compares as the largest number in Spark, so it is refused everywhere."""
    if any(isinstance(v, float) and math.isnan(v) for v in values):
        raise ValueError("a spatial argument can't be NaN")
