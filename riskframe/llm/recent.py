"""A bounded look-up table that forgets what was not used lately, and objects that
a reused Python worker keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable


class Recent:
    """Two generations of at most about ``limit`` entries.

    ``now`` is read directly; a key missing there may still be in the older
    generation (``recall``).  ``turn`` retires ``now`` once it is full.
    """

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def recall(self, key):
        """Value from the older generation, brought back, or None."""
        got = self.old.get(key)
        if got is not None:
            self.now[key] = got
        return got

    def turn(self) -> None:
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """The worker's object under ``key``, made on first use.  One object is kept at
    a time, so a worker's memory does not grow with the number of queries."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
