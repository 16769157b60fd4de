"""Sums of wide vectors over many partitions.

A task's own sum leaves it in slices. Each slice is added up on its own, so no task receives whole vectors but those that are
one slice, and the slices meet only where the sum is gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

#: Up to this many partial sums of a slice go straight to the final task.
DIRECT_PARTIALS = 64
#: Bytes of a slice.
SLICE_BYTES = 256 * 1024
#: One slice of a partial sum: the partition it comes from, the slice's number and the bytes of float64 values.
SCHEMA = "pid long, slice int, total binary"


def slice_count(values: int, slice_bytes: int = SLICE_BYTES) -> int:
    return max(1, -(-8 * values // slice_bytes))


def partial_rows(total: np.ndarray, slice_bytes: int = SLICE_BYTES) -> pa.RecordBatch:
    """A task's own sum, one row a slice."""
    flat = np.ascontiguousarray(total).reshape(-1)
    count = slice_count(flat.size, slice_bytes)
    step = max(1, slice_bytes // 8)
    parts = [flat[n * step : (n + 1) * step].tobytes() for n in range(count)]
    return _rows(np.full(count, TaskContext.get().partitionId()), np.arange(count), parts)


def _rows(pids, slices, parts: list[bytes]) -> pa.RecordBatch:
    cells = [pa.array(pids, pa.int64()), pa.array(slices, pa.int32()), pa.array(parts, pa.binary())]
    return pa.RecordBatch.from_arrays(cells, ["pid", "slice", "total"])


def _add(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, value in zip(batch.column("slice").to_pylist(), batch.column("total"), strict=True):
            part = np.frombuffer(value.as_buffer())
            if number in totals:
                totals[number] += part
            else:
                totals[number] = part.copy()
    if totals:
        here = TaskContext.get().partitionId()
        yield _rows([here] * len(totals), list(totals), [t.tobytes() for t in totals.values()])


def slice_sums(partials: DataFrame, parts: int, slices: int) -> DataFrame:
    """One row for each slice, its sum over all partial rows.

    ``parts`` is about the number of partial sums. When there are many, those of a slice first meet in about
    sqrt(parts) groups, so no task receives more than about sqrt(parts) pieces of a slice.
    """
    if parts > DIRECT_PARTIALS:
        groups = math.ceil(math.sqrt(parts))
        group = F.pmod("pid", F.lit(groups))
        partials = partials.repartition(groups * slices, "slice", group).mapInArrow(_add, SCHEMA)
    return partials.repartition(slices, "slice").mapInArrow(_add, SCHEMA)


def tree_sum(partials: DataFrame, parts: int, values: int) -> np.ndarray | None:
    """The sum of all partial sums of ``values`` numbers, None if there are none; gathered on the driver."""
    # At most one row a slice; first() would close the Python worker early and lose it for the next job.
    rows = slice_sums(partials, parts, slice_count(values)).collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["total"]) for r in sorted(rows, key=lambda r: r["slice"])])
