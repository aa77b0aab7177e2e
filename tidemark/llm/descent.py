"""Fitting a model to a stored table of training rows: sums run on executors, weights stay with the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS_AT_ONCE = 256  # rows that a task works on at a time, so that its memory does not grow with batches
PIECES = 8  # tasks of one sum, so the driver receives that many arrays at most
MEMORY = 6  # pairs of steps that the curvature is estimated from


def sum_over(rows: DataFrame, part: Callable[[Any, pa.RecordBatch], np.ndarray], state: Any, size: int) -> np.ndarray:
    """The sum of ``part(state, batch)``, arrays of ``size`` numbers, over all batches of a stored table.

    Each task adds up its own batches; no more than ``PIECES`` arrays reach the driver, whatever the
    rows are. An empty table gives zeros.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)  # of the size of the model

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                total += part(shared.value, batch.slice(start, ROWS_AT_ONCE))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rows.coalesce(PIECES).mapInArrow(add, "total binary").toArrow().column("total")
    shared.unpersist()
    return sum((np.frombuffer(p.as_py()) for p in parts), np.zeros(size))


def minimise(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, *, rounds: int, tolerance: float = 1e-5
) -> np.ndarray:
    """Least value of a smooth convex function by limited-memory BFGS, at most ``rounds`` steps.

    ``loss`` gives value and gradient. A step is halved until the value falls enough.
    """
    at, (value, slope) = start, loss(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max(initial=0.0) < tolerance:
            break
        direction, used = -slope, []
        for s, y in reversed(steps):
            used.append((s @ direction) / (s @ y))
            direction = direction - used[-1] * y
        if steps:
            s, y = steps[-1]
            direction = direction * (s @ y) / (y @ y)
        else:
            direction = direction / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(steps, reversed(used)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        length, falling = 1.0, float(slope @ direction)
        while True:
            new = at + length * direction
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * length * falling:
                break
            length /= 2
            if length < 1e-6:
                return at
        s, y = new - at, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        at, value, slope = new, new_value, new_slope
    return at
