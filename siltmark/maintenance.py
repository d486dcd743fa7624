"""The background work of a store: each event has its period, and whatever is due runs in one call or in a loop."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from .store import Store

#: Seconds between two runs of each event.
PERIODS = {"readers": 60, "logs": 500, "runs": 500, "compaction": 600}


@dataclass
class Maintenance:
    store: Store
    periods: dict[str, float] = field(default_factory=lambda: dict(PERIODS))
    clock: Callable[[], float] = time.monotonic
    last: dict[str, float] = field(default_factory=dict)
    done: list[tuple[str, object]] = field(default_factory=list)

    def __post_init__(self):
        now = self.clock()
        self.last = {k: now for k in self.periods} | self.last

    def handle(self, event: str):
        """Runs one event by its name."""
        work = {
            "readers": lambda: self.store.gc_readers(self.periods["readers"]),
            "logs": self.store.gc_logs,
            "runs": lambda: [*self.store.gc_runs(), *self.store.gc_manifests()],
            "compaction": self.store.compact_due,
            "dump": self.store.flush,
        }[event]
        result = work()
        self.done.append((event, result))
        return result

    def due(self) -> list[str]:
        now = self.clock()
        return [k for k, p in self.periods.items() if now - self.last[k] >= p]

    def tick(self) -> list[str]:
        """Runs what is due, and returns the names."""
        events = self.due()
        for e in events:
            self.last[e] = self.clock()
            self.handle(e)
        return events

    def run(self, stop: Callable[[], bool], pause: float = 1.0) -> None:
        """Until stop() is true."""
        while not stop():
            self.tick()
            time.sleep(pause)
