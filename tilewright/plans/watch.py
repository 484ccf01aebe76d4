"""Watching a job from snapshots of its state until it ends or a limit is met."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from tilewright.operators.monitoring import COUNTERS

ENDED = ("done", "failed", "cancelled")


@dataclass(frozen=True)
class Limits:
    """max_runtime, grace and idle in seconds (None: no limit). Failures are a share of the tiles."""

    max_runtime: float | None = 12 * 3600.0
    most_failures: float | None = 0.5
    grace: float = 600.0
    idle: float | None = 20 * 60.0


@dataclass
class State:
    status: str
    elapsed: float
    counters: dict[str, float] = field(default_factory=dict)
    tripped: str | None = None


def poll(snapshot: Callable[[], dict], limits: Limits | None = None, tiles: int = 0, callback: Callable[[State], None] | None = None, cancel: Callable[[], None] | None = None, interval: float = 15.0, pause: Callable[[float], None] = time.sleep) -> State:
    """The last state of a job.

    snapshot: gives status, elapsed (seconds since the start) and counters, or raises StopIteration at the end.
    A job is idle while no counter passes its own highest value; a counter that falls back is no progress.
    cancel is called once, where a limit is met.
    """
    limits = limits or Limits()
    highest: dict[str, float] = {}
    moved, state = None, State("unknown", 0.0)
    while True:
        try:
            now = snapshot()
        except StopIteration:
            return state
        state = State(now.get("status", "running"), float(now.get("elapsed", 0.0)), dict(now.get("counters", {})))
        moved = state.elapsed if moved is None else moved
        for name in COUNTERS:
            if state.counters.get(name, 0) > highest.get(name, 0):
                highest[name], moved = state.counters[name], state.elapsed
        if state.status not in ENDED:
            state.tripped = broken(state, limits, tiles, moved)
        if callback:
            callback(state)
        if state.tripped and cancel:
            cancel()
        if state.tripped or state.status in ENDED:
            return state
        pause(interval)


def broken(state: State, limits: Limits, tiles: int, moved: float) -> str | None:
    """The limit that a running job has met, in words."""
    if limits.max_runtime is not None and state.elapsed > limits.max_runtime:
        return f"it runs for {state.elapsed:.0f} s, over {limits.max_runtime:.0f}"
    failed = state.counters.get("failures_written", 0)
    if limits.most_failures is not None and tiles and state.elapsed > limits.grace and failed / tiles > limits.most_failures:
        return f"{failed:.0f} of {tiles} tiles failed"
    if limits.idle is not None and state.elapsed > limits.grace and state.elapsed - moved > limits.idle:
        return f"nothing has moved for {state.elapsed - moved:.0f} s"
    return None
