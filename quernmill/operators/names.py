"""Names that don't clash."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores appended until none of the taken names is the same in any letter case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
