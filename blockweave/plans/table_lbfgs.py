"""L-BFGS for vectors that are kept as tables ``(slot bigint, v array<double>)``, one row for each piece of a vector.

The direction is a linear combination of the kept pairs and the slope, and its coefficients follow from their inner
products. So an iteration takes one aggregate of all inner products, a few numbers on the driver, and one
pass that combines the pieces; no vector comes to the driver. Pairs, point and slope lie side by side in one table,
which is written in each iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.operators.reduce import SCHEMA, partial_rows, tree_sum
from blockweave.plans.search import wolfe_step
from blockweave.session import cut, shuffle_partitions

#: ``cost(point table) -> (value, slope table)``; both tables hold the same slots.
Cost = Callable[[DataFrame], tuple[float, DataFrame]]


def _pieces(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """The values of each vector in a batch of slots, end to end."""
    parts = [batch.column(n) for n in names]
    first = parts[0].value_lengths()
    for name, part in zip(names, parts, strict=True):
        if part.null_count or not part.value_lengths().equals(first):
            raise ValueError(f"a slot of {name} is missing or of another length")
    return [p.flatten().to_numpy(zero_copy_only=False) for p in parts]


def inner_products(table: DataFrame, names: list[str]) -> np.ndarray:
    """All inner products of the vectors in columns ``names``, as a small matrix on the driver."""
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                rows = np.stack(_pieces(batch, names))
                total += rows @ rows.T
        yield partial_rows(total)

    partials = table.select(*names).mapInArrow(run, SCHEMA)
    total = tree_sum(partials, shuffle_partitions(table.sparkSession), size * size)
    return np.zeros((size, size)) if total is None else total.reshape(size, size)


def combined(table: DataFrame, names: list[str], sums: dict[str, list[float]], keep: list[str]) -> DataFrame:
    """``slot``, the columns ``keep``, and for each of ``sums`` a linear combination of the vectors ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack(_pieces(batch, names)) if batch.num_rows else np.zeros((len(names), 0))
            offsets = np.concatenate([[0], np.cumsum(batch.column(names[0]).value_lengths().to_numpy())]).astype(np.int32)
            made = [pa.ListArray.from_arrays(offsets, pa.array(np.asarray(c) @ rows)) for c in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), *(batch.column(k) for k in keep), *made], ["slot", *keep, *sums]
            )

    schema = ", ".join(["slot bigint", *(f"{n} array<double>" for n in [*keep, *sums])])
    return table.select("slot", *dict.fromkeys([*names, *keep])).mapInArrow(run, schema)


def direction_of(products: np.ndarray, pairs: int) -> np.ndarray:
    """Coefficients of the search direction over (moves, bends, slope), from their inner products.

    The two-loop recursion on coefficients: a vector is its coefficients, an inner product is taken through ``products``.
    """
    slope = np.zeros(2 * pairs + 1)
    slope[-1] = 1.0
    basis = np.eye(2 * pairs + 1)
    result, scales = slope.copy(), [0.0] * pairs
    for k in reversed(range(pairs)):
        moved, bent = basis[k], basis[pairs + k]
        scales[k] = (moved @ products @ result) / (moved @ products @ bent)
        result = result - scales[k] * bent
    if pairs:
        moved, bent = basis[pairs - 1], basis[2 * pairs - 1]
        result = result * ((moved @ products @ bent) / (bent @ products @ bent))
    for k in range(pairs):
        moved, bent = basis[k], basis[pairs + k]
        result = result + moved * (scales[k] - (bent @ products @ result) / (moved @ products @ bent))
    return -result


def minimise(
    start: DataFrame, cost: Cost, *, corrections: int = 10, tol: float = 1e-6, iterations: int = 200
) -> tuple[DataFrame, list[tuple[int, float]]]:
    """The point where ``cost`` is least, as a table, and (iteration, value) from the start on."""
    point = cut(start.select("slot", F.col("v").alias("x")))
    value, slope = cost(point.select("slot", F.col("x").alias("v")))
    state = cut(point.join(slope.select("slot", F.col("v").alias("g")), "slot"))
    history, pairs, first = [(0, value)], 0, value
    for iteration in range(1, iterations + 1):
        names = [f"s{k}" for k in range(pairs)] + [f"y{k}" for k in range(pairs)] + ["g"]
        products = inner_products(state, names)
        steep = float(products[-1, -1]) ** 0.5
        if steep <= max(tol * abs(value), 1e-12):
            break
        if not np.isfinite(steep):
            raise ValueError("the slope is not finite")
        weights = direction_of(products, pairs)
        descent = float(products[-1] @ weights)
        if descent >= 0:
            state, pairs, names = state.select("slot", "x", "g"), 0, ["g"]
            weights, descent = np.array([-1.0]), -(steep**2)
        state = cut(combined(state, names, {"d": list(weights)}, ["x", *names]))

        def at(step: float, held: DataFrame = state):
            moved = cut(combined(held, ["x", "d"], {"v": [1.0, step]}, []))
            value, slope = cost(moved)
            there = cut(moved.select("slot", F.col("v").alias("x1")).join(slope.select("slot", F.col("v").alias("g1")), "slot"))
            along = inner_products(held.select("slot", "d").join(there.select("slot", "g1"), "slot"), ["d", "g1"])[0, 1]
            return value, float(along), there

        found = wolfe_step(at, value, descent, 1.0 if pairs else min(1.0, 1.0 / steep))
        if found is None:
            break
        new_value, _, there = found
        # the new pair: how far the point moved and the slope changed
        kept = list(range(max(0, pairs + 1 - corrections), pairs))
        renamed = [F.col(f"{c}{k}").alias(f"{c}{n}") for n, k in enumerate(kept) for c in "sy"]
        both = state.select("slot", "x", "g", *renamed).join(there, "slot")
        old = [f"{c}{n}" for n in range(len(kept)) for c in "sy"]
        s, y = f"s{len(kept)}", f"y{len(kept)}"
        both = combined(both, ["x", "g", "x1", "g1"], {s: [-1.0, 0.0, 1.0, 0.0], y: [0.0, -1.0, 0.0, 1.0]}, ["x1", "g1", *old])
        state = cut(both.withColumnsRenamed({"x1": "x", "g1": "g"}))
        bend = inner_products(state, [s, y])
        if bend[0, 1] > 1e-12 * bend[1, 1]:
            pairs = len(kept) + 1
        else:
            state, pairs = state.drop(s, y), len(kept)
        history.append((iteration, new_value))
        change, scale = abs(value - new_value), max(abs(value), abs(new_value), 1e-6 * abs(first))
        value = new_value
        if change <= tol * scale:
            break
    return state.select("slot", F.col("x").alias("v")), history
