"""Sums of arrays that every task has a part of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm.common import tidied

#: Slice, group of tasks, and 32-bit floats.
SCHEMA = "k int, g int, part binary"


def summed(rows: DataFrame, size: int, slices: int, tasks: int) -> np.ndarray:
    """Sums arrays that tasks return in slices (k, g, part): first inside groups g of about the root of all tasks, then
    slice by slice, so that no task reads more than that root of parts; the driver gets one array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                values = np.frombuffer(part.as_buffer(), np.float32)
                total[k] = total[k] + values if k in total else values.astype(float)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["k", "g", "part"])

    if tasks > 16:
        rows = rows.repartition("k", "g").mapInArrow(tidied(add), SCHEMA)
    out = np.zeros((slices, size // slices))
    for r in rows.repartition(slices, "k").mapInArrow(tidied(add), SCHEMA).collect():
        out[r["k"]] += np.frombuffer(r["part"], np.float32)
    return out.ravel()


def sliced(values: np.ndarray, slices: int, tasks: int) -> Iterator[pa.RecordBatch]:
    group = TaskContext.get().partitionId() % max(1, int(tasks**0.5))
    for k, part in enumerate(values.astype(np.float32).reshape(slices, -1)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([group], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "g", "part"])
