"""Groups of samples ("stacks") in a repeatable order, and their flat-vector form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.functions import arrow
from blockweave.session import cut

_ROW_BITS = 33


def assign_stacks(samples: DataFrame, stack_size: int, order_by: str | None = None) -> DataFrame:
    """Add ``stack_id``, the place ``stack_pos`` in the stack and the stack's size ``stack_n``.

    With ``order_by`` (a unique column) stacks are runs of the whole order, so they do not depend on
    the partitioning: the rows are range-partitioned and each partition's start is added to the local
    row number. Without it, stacks are runs inside each partition. The numbered rows are written to
    the checkpoint folder once, because a recomputed row must keep its number.
    """
    if stack_size < 1:
        raise ValueError("stack size must be at least 1")
    names = samples.columns
    placed = samples
    if order_by is not None:
        placed = samples.repartitionByRange(order_by).sortWithinPartitions(order_by)
    rows = cut(placed.withColumn("_n", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_n", _ROW_BITS)).withColumn(
        "_n", F.col("_n").bitwiseAND((1 << _ROW_BITS) - 1)
    )
    # One row per partition from here: small whatever the data size.
    counts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    if order_by is not None:
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(
            F.col("_part"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
            F.sum("_rows").over(Window.partitionBy()).alias("_rows"),
        )
        rows = rows.join(F.broadcast(starts), "_part")
        rows = rows.withColumn("_n", F.col("_n") + F.col("_start"))
        high = F.lit(0)
    else:
        rows = rows.join(F.broadcast(counts), "_part")
        high = F.shiftleft("_part", _ROW_BITS)
    local = F.expr(f"_n div {stack_size}L")
    return rows.select(
        *names,
        (high + local).cast("bigint").alias("stack_id"),
        (F.col("_n") % stack_size).cast("int").alias("stack_pos"),
        F.least(F.lit(stack_size), F.col("_rows") - local * stack_size).cast("int").alias("stack_n"),
    )


def stack_rows(assigned: DataFrame, features: str = "features", target: str = "target") -> DataFrame:
    """``(stack_id, n, inputs, targets)``: the vectors of a stack one after the other.

    A group is one stack, so it never holds more than the stack size.
    """
    row = F.struct("stack_pos", F.col(features).alias("x"), F.col(target).alias("t"))
    listed = assigned.groupBy("stack_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return listed.select(
        "stack_id",
        F.size("rows").alias("n"),
        F.flatten("rows.x").alias("inputs"),
        F.flatten("rows.t").alias("targets"),
    )


def unstack_rows(stacks: DataFrame) -> DataFrame:
    """Back to one sample per row: ``(stack_id, stack_pos, features, target)``.

    The vector lengths follow from the array lengths and the stack's size.
    """

    def piece(name: str):
        width = F.expr(f"cast(size({name}) div n as int)")
        return F.slice(name, F.col("stack_pos") * width + 1, width)

    positions = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("stack_pos")
    return stacks.where(F.col("n") > 0).select("*", positions).select(
        "stack_id", "stack_pos", piece("inputs").alias("features"), piece("targets").alias("target")
    )


def share_by_stack(
    batches: Iterator[pa.RecordBatch], stack_size: int
) -> Iterator[pa.RecordBatch]:
    """Append ``share`` = 1 / size of the row's stack, for stacks formed in arrival order.

    At most one stack of rows is held back, to learn whether the last one is short.
    """
    rest: pa.Table | None = None

    def shared(rows: pa.Table, size: int):
        for batch in rows.combine_chunks().to_batches():
            share = pa.array(np.full(batch.num_rows, 1.0 / size))
            yield pa.RecordBatch.from_arrays([*batch.columns, share], [*batch.schema.names, "share"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        whole = rest.num_rows // stack_size * stack_size
        if whole:
            yield from shared(rest.slice(0, whole), stack_size)
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield from shared(rest, rest.num_rows)


def with_share(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows without a ``share`` count once each."""
    if "share" in batch.schema.names:
        return batch
    ones = pa.array(np.ones(batch.num_rows))
    return pa.RecordBatch.from_arrays([*batch.columns, ones], [*batch.schema.names, "share"])


#: Bytes of features in one packed row, at most.
PACK_BYTES = 1 << 20
#: Features with a smaller part of non-zero values are packed as places and values.
SPARSE_BELOW = 0.4


def pack(rows: DataFrame, stack_size: int | None, by: str | None = None) -> DataFrame:
    """Samples ``(features, label | target [, share])`` as rows of many samples in bytes.

    With ``stack_size`` the share of a row is 1 / size of its stack, stacks being formed in arrival
    order inside a partition. Single-precision features stay so; mostly zero features are kept sparse.
    With ``by``, a column of whole numbers, a packed row holds samples of one number and tells it; rows of one
    number should lie together.
    """
    kind = rows.schema["features"].dataType.elementType.typeName()
    dtype = np.float32 if kind == "float" else np.float64
    result = "target" if "target" in rows.columns else "label"
    schema = (
        "n int, width int, single boolean, places binary, features binary, "
        f"{result} binary, share binary"
    )
    if by is not None:
        schema += f", {by} bigint"

    def run(batches):
        if stack_size is not None:
            batches = share_by_stack(batches, stack_size)
        for batch, number in numbered(map(with_share, batches)):
            lengths = pc.list_value_length(batch.column("features"))
            # Uneven vectors are packed apart; the caller sees the widths and refuses them.
            for width in pc.unique(lengths).to_pylist():
                same = batch.filter(pc.equal(lengths, width)) if width is not None else batch
                x = arrow.to_matrix(same.column("features")).astype(dtype, copy=False)
                if result == "target":
                    y = arrow.to_matrix(same.column("target"))
                else:
                    y = same.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                share = same.column("share").to_numpy()
                step = max(1, PACK_BYTES // (x.itemsize * max(width, 1)))
                for a in range(0, len(x), step):
                    yield _packed(x[a : a + step], y[a : a + step], share[a : a + step], number)

    def numbered(batches):
        for batch in batches:
            if by is None:
                yield batch, None
                continue
            numbers = batch.column(by)
            for number in pc.unique(numbers):
                yield batch.filter(pc.equal(numbers, number)), number.as_py()

    def _packed(x, y, share, number):
        flat = x.reshape(-1)
        places = np.flatnonzero(flat)
        if places.size < SPARSE_BELOW * flat.size:
            kept, flat = places.astype(np.uint32).tobytes(), flat[places]
        else:
            kept = None
        cells = [len(x), x.shape[1], dtype == np.float32, kept, flat.tobytes(), y.tobytes(), share.tobytes()]
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        arrays = [pa.array([c], t) for c, t in zip(cells, types, strict=True)]
        names = ["n", "width", "single", "places", "features", result, "share"]
        if by is not None:
            arrays, names = [*arrays, pa.array([number], pa.int64())], [*names, by]
        return pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, schema)


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows back to batches of samples: ``features``, ``label`` or ``target``, ``share``."""

    def numbers(value, dtype=np.float64):
        return np.frombuffer(value.as_buffer(), dtype=dtype)

    for batch in batches:
        names = batch.schema.names
        result = "target" if "target" in names else "label"
        columns = [batch.column(c) for c in ("n", "width", "single", "places", "features", result, "share")]
        for n, width, single, places, values, y, share in zip(*columns, strict=True):
            n, width = n.as_py(), width.as_py()
            flat = numbers(values, np.float32 if single.as_py() else np.float64)
            if places.is_valid:
                dense = np.zeros(n * width)
                dense[numbers(places, np.uint32)] = flat
                flat = dense
            y = numbers(y)
            goal = pa.array(y) if result == "label" else arrow.to_lists(y.reshape(n, -1))
            yield pa.RecordBatch.from_arrays(
                [arrow.to_lists(flat.reshape(n, width)), goal, pa.array(numbers(share))],
                ["features", result, "share"],
            )
