"""Aggregates whose state is an array or several: built batch by batch in tasks, merged by tasks, then on the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

T = TypeVar("T")
_STATE = "part int, state binary"


def merged(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], T], merge: Callable[[T, T], T], groups: int = 16, tasks: int | None = None) -> T | None:
    """``merge`` of ``of_batch`` over all batches of ``rows``, None without rows. The tasks' states are dealt to ``groups``
    tasks, whose states one task merges, so that the driver is sent a single one; the first is left out if ``tasks``, the
    number of tasks, is known to be no more, and both if it is one."""

    def told(state: T | None) -> Iterator[pa.RecordBatch]:
        if state is not None:
            part = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(state, protocol=5)], pa.binary())], names=["part", "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                own = of_batch(batch)
                state = own if state is None else merge(state, own)
        yield from told(state)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for own in map(pickle.loads, batch.column(1).to_pylist()):
                state = own if state is None else merge(state, own)
        yield from told(state)

    states = rows.mapInArrow(partial, _STATE)
    if tasks is None or tasks > groups:
        states = states.repartition(groups, "part").mapInArrow(together, _STATE)
    if tasks != 1:
        states = states.repartition(1).mapInArrow(together, _STATE)  # ``groups`` states at most
    state = None
    for r in states.collect():
        own = pickle.loads(bytes(r.state))
        state = own if state is None else merge(state, own)
    return state


#: Number of rows, mean and sum of squared deviations of each column.
Moments = tuple[int, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    d = x - mean
    mean = mean + (d.mean(axis=0) if len(x) else 0)  # what the first mean has lost at large values
    return len(x), mean, ((x - mean) ** 2).sum(axis=0)


def merge_moments(a: Moments, b: Moments) -> Moments:
    """Those of both sets of rows, without sums of squares that cancel."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return b if b[0] else a
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of one length as the rows of a matrix; nulls are NaN."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = width or (len(values) // len(column) if len(column) else 0)
    if len(values) != len(column) * width or column.null_count:
        raise ValueError("features must have one length")
    return values.reshape(len(column), width)
