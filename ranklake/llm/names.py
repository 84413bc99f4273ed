"""Names for columns that an operator adds for itself."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, longer where a column has it already (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
