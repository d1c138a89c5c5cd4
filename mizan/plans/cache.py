"""A result cache on the driver: least recently used goes first, entries expire."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable


class ResultCache:
    """get(key, now) and set(key, value, now); a hit makes the entry the most recent.

    An entry is gone once its age reaches `ttl` seconds.
    """

    def __init__(self, size: int = 200, ttl: float = 300.0):
        self.size, self.ttl = size, ttl
        self._rows: OrderedDict[Hashable, tuple[float, object]] = OrderedDict()

    def get(self, key: Hashable, now: float):
        if key not in self._rows:
            return None
        then, value = self._rows[key]
        if now - then >= self.ttl:
            del self._rows[key]
            return None
        self._rows.move_to_end(key)
        return value

    def set(self, key: Hashable, value, now: float) -> None:
        self._rows[key] = (now, value)
        self._rows.move_to_end(key)
        while len(self._rows) > self.size:
            self._rows.popitem(last=False)

    def cached(self, key: Hashable, now: float, make: Callable[[], object]):
        found = self.get(key, now)
        if found is None:
            found = make()
            self.set(key, found, now)
        return found


def catalog_status(rows: int, cached_at: float | None, now: float, ttl: float = 3600.0) -> dict:
    """Age and validity of the catalog: younger than the limit and not empty."""
    age = None if cached_at is None else now - cached_at
    return {"rows": rows, "age_seconds": age, "valid": rows > 0 and age is not None and age < ttl}


def health(degraded: bool, initializing: bool, uptime: float) -> dict:
    """Status, DEGRADED before INITIALIZING before OK, and the uptime."""
    hours, rest = divmod(int(uptime), 3600)
    status = "DEGRADED" if degraded else "INITIALIZING" if initializing else "OK"
    return {"status": status, "uptime": f"{hours}h {rest // 60}m {rest % 60}s"}
