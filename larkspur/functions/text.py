"""Names made from labels, and JSON-safe numbers."""

from __future__ import annotations

import math


def slug(label: str) -> str:
    """Lower case, every character that is no letter, digit or underscore as an underscore."""
    return "".join(c if c.isalnum() or c == "_" else "_" for c in label).lower()


def finite(x: float | None, digits: int | None = None) -> float | str | None:
    """A number for JSON, which has no infinity: 'inf' and '-inf' as text, NaN as null."""
    if x is None or math.isnan(x):
        return None
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return round(x, digits) if digits is not None else x
