"""Running bounded streams to their end, with restarts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import DataStreamWriter


def drain(writer: DataStreamWriter, timeout: int | None = None) -> list[dict]:
    """Process everything that is there, then stop; returns the last progress reports.
    Only a caller that gives a ``timeout``, in seconds, sets a limit."""
    query = writer.trigger(availableNow=True).start()
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream not finished after {timeout} seconds")
        return [json.loads(p.json) for p in query.recentProgress]
    finally:
        query.stop()


def drain_with_restarts(
    attempt: Callable[[int], DataStreamWriter],
    restarts: int = 1,
    delay: float = 0.0,
    timeout: int | None = None,
) -> int:
    """``drain(attempt(i))``, started again after a failure; returns the failures.

    Every attempt must use the same checkpoint: it goes on at the batch that
    failed, and the sink keeps what was complete before.
    """
    for i in range(restarts + 1):
        try:
            drain(attempt(i), timeout)
            return i
        except StreamingQueryException:
            if i == restarts:
                raise
            time.sleep(delay)
    raise AssertionError("not reached")
