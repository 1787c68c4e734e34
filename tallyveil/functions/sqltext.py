"""Expression text for machine-made expressions.

A nested comparison over hundreds of labels is one text handed to Spark's parser instead of hundreds of
calls from Python; the expression is the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A literal of a label or number."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if abs(value) > 2**31 - 1 else str(value)
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: Sequence) -> str:
    return "array(" + ", ".join(literal(v) for v in values) + ")"


def search(cuts: Sequence[str], leaf: Callable[[int], str], test: str, low: int = 0, high: int | None = None) -> str:
    """Balanced CASE tree: leaf(i) for the first i whose test `... cuts[i]` holds, else the last leaf.

    `test` is the left side and the operator, e.g. "`x` <=".
    """
    high = len(cuts) if high is None else high
    if low == high:
        return leaf(low)
    mid = (low + high) // 2
    return (f"CASE WHEN {test} {cuts[mid]} THEN {search(cuts, leaf, test, low, mid)} "
            f"ELSE {search(cuts, leaf, test, mid + 1, high)} END")
