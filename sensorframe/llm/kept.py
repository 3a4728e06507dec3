"""What a Python worker keeps between its tasks: the state of one operator, so that a long pipeline does not add them up."""

from __future__ import annotations

from collections.abc import Callable

_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gave for this key in this process; what was kept for another key goes first."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
