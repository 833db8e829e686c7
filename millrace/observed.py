"""Metrics that a job reports besides its result."""

from __future__ import annotations

from threading import Thread

from pyspark.sql import Observation

# Seconds in which metrics have to follow the end of their job.
WAIT = 60.0


def observed(seen: Observation, wait: float | None = None) -> dict[str, object] | None:
    """What ``seen`` was told, or None if nothing has come.

    Spark reports metrics soon after a job; a job that never ran has none, and
    the event of one that did is lost if Spark's listeners cannot keep up.
    """
    found: list[dict[str, object]] = []
    waiting = Thread(target=lambda: found.append(dict(seen.get)), daemon=True)
    waiting.start()
    waiting.join(WAIT if wait is None else wait)
    return found[0] if found else None
