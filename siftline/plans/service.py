"""Driver-side services: a result cache by plan, a circuit breaker, pattern checks, cost estimates."""

from __future__ import annotations

import fnmatch
import re
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from siftline.plans.scratch import cut, drop


class ResultCache:
    """Tables of results by their whole plan and the version of what they read; least used go first."""

    def __init__(self, size: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, df: DataFrame, version: str = "") -> DataFrame:
        key = f"{version}:{df.semanticHash()}:{df._jdf.queryExecution().analyzed().canonicalized().toString()}"
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][1]
        self.misses += 1
        if key in self.held:
            drop(self.held.pop(key)[1])
        out = cut(df, "result")
        self.held[key] = (now, out)
        while len(self.held) > self.size:
            drop(self.held.popitem(last=False)[1][1])
        return out

    def invalidate(self, pattern: str = "*") -> int:
        """Drops results whose version matches a glob; returns how many."""
        gone = [k for k in self.held if fnmatch.fnmatch(k.split(":", 1)[0], pattern)]
        for k in gone:
            drop(self.held.pop(k)[1])
        return len(gone)

    def stats(self) -> dict:
        n = self.hits + self.misses
        return {"entries": len(self.held), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / n if n else 0.0}


class CircuitBreaker:
    """Refuses calls for ``seconds`` after ``limit`` failures; then one try decides."""

    def __init__(self, limit: int = 5, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.limit, self.seconds, self.clock = limit, seconds, clock
        self.failures, self.opened = 0, None

    def call(self, f: Callable, *args, **kwargs):
        if self.opened is not None and self.clock() - self.opened < self.seconds:
            raise RuntimeError("the circuit is open")
        trying = self.opened is not None
        try:
            out = f(*args, **kwargs)
        except Exception:
            self.failures += 1
            if trying or self.failures >= self.limit:
                self.opened = self.clock()
            raise
        if trying:
            self.failures, self.opened = 0, None
        return out


def check_pattern(pattern: str, most: int = 1000) -> list[str]:
    """What is wrong with a regex: too long, nested repetition, or not a regex."""
    wrong = []
    if len(pattern) > most:
        wrong.append(f"longer than {most} characters")
    if re.search(r"\([^)]*[+*]\)[+*]", pattern):
        wrong.append("repeats a repetition")
    try:
        re.compile(pattern)
    except re.error as e:
        wrong.append(f"not a regex: {e}")
    return wrong


def estimated_seconds(files: int, workers: int, syntax: bool = False, regex: bool = False) -> float:
    """Relative cost of a search: five times for syntax trees, twice for regexes, over the workers."""
    return files * (5 if syntax else 1) * (2 if regex else 1) / max(1.0, workers * 0.8)
