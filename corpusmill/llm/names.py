"""Names for columns of our own that no column of a table has."""

from __future__ import annotations

from itertools import count


def free_names(taken: list[str], n: int) -> list[str]:
    """``n`` names that are not in ``taken``, whatever their case."""
    used = {c.lower() for c in taken}
    fresh = (name for i in count() if (name := f"own_{i}") not in used)
    return [next(fresh) for _ in range(n)]
