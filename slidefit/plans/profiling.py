"""Time and memory of driver-side functions; Spark's own work shows in its UI and event log."""

from __future__ import annotations

import functools
import time
import tracemalloc
from dataclasses import dataclass

#: Share of the elapsed time that the CPU must have worked for a record to count as undisturbed.
CPU_SHARE = 0.9
_on = False
_records: list[Record] = []


@dataclass(frozen=True)
class Record:
    """One call."""

    name: str
    seconds: float
    cpu_seconds: float
    peak_bytes: int

    def is_reliable(self, threshold: float = CPU_SHARE) -> bool:
        return self.cpu_seconds >= threshold * self.seconds


def enable() -> None:
    global _on
    _on = True


def disable() -> None:
    global _on
    _on = False


def clear() -> None:
    _records.clear()


def get_records() -> list[Record]:
    return list(_records)


def get_reliable_records(threshold: float | None = None) -> list[Record]:
    return [r for r in _records if r.is_reliable(CPU_SHARE if threshold is None else threshold)]


def report(top: int = 15) -> str:
    """The calls that took longest, as lines of text; printed, too."""
    rows = sorted(_records, key=lambda r: -r.seconds)[:top]
    text = "\n".join(f"{r.seconds:10.4f} s {r.cpu_seconds:10.4f} s CPU {r.peak_bytes / 1e6:8.1f} MB  {r.name}" for r in rows)
    print(text)
    return text


def profile(func):
    """Records calls while profiling is on."""

    @functools.wraps(func)
    def call(*args, **kwargs):
        if not _on:
            return func(*args, **kwargs)
        began, cpu, tracing = time.perf_counter(), time.process_time(), tracemalloc.is_tracing()
        if not tracing:
            tracemalloc.start()
        try:
            return func(*args, **kwargs)
        finally:
            _records.append(Record(func.__qualname__, time.perf_counter() - began, time.process_time() - cpu, tracemalloc.get_traced_memory()[1]))
            if not tracing:
                tracemalloc.stop()

    return call
