"""Matrices in entry form: a DataFrame ``(i bigint, j bigint, v double)``; an absent cell is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.functions.columns import divide_ieee, zero_or_ratio
from blockweave.session import BROADCAST_BYTES, ENTRY_BYTES, HOT_ENTRIES, HOT_PAIRS, cut


def to_entries(df: DataFrame, i: Column | str, j: Column | str, v: Column | str) -> DataFrame:
    """Pick three columns as row index, column index and value."""

    def column(x):
        return F.col(x) if isinstance(x, str) else x

    return df.select(
        column(i).cast("bigint").alias("i"),
        column(j).cast("bigint").alias("j"),
        column(v).cast("double").alias("v"),
    )


def sum_duplicates(entries: DataFrame) -> DataFrame:
    """One entry per cell; repeated cells are added up."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def matrix_shape(entries: DataFrame) -> DataFrame:
    """One row ``(rows, cols)``: largest index plus one, 0 x 0 for an empty matrix."""
    return entries.agg(
        F.coalesce(F.max("i") + 1, F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.max("j") + 1, F.lit(0)).cast("bigint").alias("cols"),
    )


def matrix_profile(entries: DataFrame, block_rows: int, block_cols: int) -> DataFrame:
    """One row: size, block grid, mean block size (whole numbers) and stored cells."""
    size = entries.agg(
        F.coalesce(F.max("i") + 1, F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.max("j") + 1, F.lit(0)).cast("bigint").alias("cols"),
        F.count("*").alias("stored"),
    )
    return profile_of(size, block_rows, block_cols)


def profile_of(size: DataFrame, block_rows: int, block_cols: int) -> DataFrame:
    """The profile of a matrix from its row ``(rows, cols, stored)``."""
    grid = size.withColumn("row_blocks", F.ceil(F.col("rows") / block_rows)).withColumn(
        "col_blocks", F.ceil(F.col("cols") / block_cols)
    )
    return grid.select(
        "rows",
        "cols",
        "row_blocks",
        "col_blocks",
        F.expr("coalesce(rows div nullif(row_blocks, 0), 0)").alias("block_rows"),
        F.expr("coalesce(cols div nullif(col_blocks, 0), 0)").alias("block_cols"),
        "stored",
    )


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _fits(cells: int | None) -> bool:
    return cells is not None and cells * ENTRY_BYTES <= BROADCAST_BYTES


def _hot_inner_keys(a: DataFrame, b: DataFrame, hot: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Every inner index with more than ``hot`` entries on a side or ``hot_pairs`` pairs, and its salts.

    A task gets at most about ``hot`` entries of a side and ``hot_pairs`` pairs of one index.
    """
    counted = (
        a.select(F.col("j").alias("key"), F.lit(1).alias("x"), F.lit(0).alias("y"))
        .unionAll(b.select(F.col("i").alias("key"), F.lit(0).alias("x"), F.lit(1).alias("y")))
        .groupBy("key")
        .agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    )
    pairs = F.col("x").cast("double") * F.col("y")
    each = min(float(hot), hot_pairs**0.5)

    def salts(count: str) -> Column:
        return F.greatest(F.ceil(F.col(count) / F.lit(each)), F.lit(1)).cast("int")

    too_many = (F.col("x") > hot) | (F.col("y") > hot) | (pairs > hot_pairs)
    return counted.where(too_many).select("key", salts("x").alias("a_salts"), salts("y").alias("b_salts"))


def multiply(
    a: DataFrame,
    b: DataFrame,
    *,
    a_cells: int | None = None,
    b_cells: int | None = None,
    hot: int | None = HOT_ENTRIES,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Matrix product as an equi-join on the inner index and a sum.

    A side whose known number of cells fits the broadcast limit is broadcast. Otherwise both sides
    are shuffled on the inner index, and an index that holds more than ``hot`` entries, or makes more than
    ``hot_pairs`` pairs, is split: each side gets its own salt and is repeated over the other side's salts.
    The table of such indices is made once and broadcast only if it is small. Pass ``hot=None`` when no inner
    index can hold many entries on either side.

    A side of unknown size asks for a merge join: Spark's estimate of exploded factor rows leaves the explosion out, and
    adaptive execution would broadcast them through the driver once the table of split indices turns out empty.
    """
    left, right = a.alias("a"), b.alias("b")
    on = F.col("a.j") == F.col("b.i")
    if _fits(b_cells):
        pairs = left.join(F.broadcast(right), on)
    elif _fits(a_cells):
        pairs = F.broadcast(left).join(right, on)
    elif hot is None:
        pairs = left.join(right.hint("merge"), on)
    else:
        keys = cut(_hot_inner_keys(a, b, hot, hot_pairs))
        if _fits(keys.count()):
            keys = F.broadcast(keys)
        else:
            keys = keys.hint("merge")

        def other(name: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(name), F.lit(1)) - 1))

        def own(index: str, name: str) -> Column:
            return F.pmod(F.xxhash64(index), F.coalesce(F.col(name), F.lit(1))).cast("int")

        left = (
            a.join(keys, a["j"] == keys["key"], "left")
            .select("i", "j", "v", own("i", "a_salts").alias("sa"), other("b_salts").alias("sb"))
            .alias("a")
        )
        right = (
            b.join(keys, b["i"] == keys["key"], "left")
            .select("i", "j", "v", own("j", "b_salts").alias("sb"), other("a_salts").alias("sa"))
            .alias("b")
        )
        on = on & (F.col("a.sa") == F.col("b.sa")) & (F.col("a.sb") == F.col("b.sb"))
        pairs = left.join(right.hint("merge"), on)
    return (
        pairs.select(
            F.col("a.i").alias("i"), F.col("b.j").alias("j"), (F.col("a.v") * F.col("b.v")).alias("v")
        )
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
    )


def elementwise_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """A∘B on one entry per cell; a cell absent on either side is zero and stays absent."""
    b = b.select("i", "j", F.col("v").alias("bv"))
    return a.join(b, ["i", "j"]).select("i", "j", (F.col("v") * F.col("bv")).alias("v"))


def elementwise_division(a: DataFrame, b: DataFrame) -> DataFrame:
    """A⊘B over the cells of the numerator; an absent denominator counts as zero."""
    b = b.select("i", "j", F.col("v").alias("bv"))
    quotient = divide_ieee(F.col("v"), F.coalesce("bv", F.lit(0.0)))
    return a.join(b, ["i", "j"], "left").select("i", "j", quotient.alias("v"))


def multiply_divide(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """A∘B⊘C in one projection over two joins on the same key.

    A zero product gives zero whatever the denominator is.
    """
    b = b.select("i", "j", F.col("v").alias("bv"))
    c = c.select("i", "j", F.col("v").alias("cv"))
    product = F.col("v") * F.coalesce("bv", F.lit(0.0))
    ratio = zero_or_ratio(product, F.coalesce("cv", F.lit(0.0)))
    return (
        a.join(b, ["i", "j"], "left").join(c, ["i", "j"], "left").select("i", "j", ratio.alias("v"))
    )


def cogroup(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both values of every cell that either side holds: ``(i, j, a, b)``, null when absent."""
    left = a.select("i", "j", F.col("v").alias("a"))
    right = b.select("i", "j", F.col("v").alias("b"))
    return left.join(right, ["i", "j"], "full")


def cogroup3(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """All three values of every cell that any side holds: ``(i, j, a, b, c)``."""
    third = c.select("i", "j", F.col("v").alias("c"))
    return cogroup(a, b).join(third, ["i", "j"], "full")


def to_dense(entries: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell of a rows x cols matrix, zero where no entry exists."""
    grid = entries.sparkSession.range(rows * cols).select(
        F.expr(f"id div {max(cols, 1)}L").alias("i"), (F.col("id") % max(cols, 1)).alias("j")
    )
    return grid.join(entries, ["i", "j"], "left").select(
        "i", "j", F.coalesce("v", F.lit(0.0)).alias("v")
    )


def to_sparse(entries: DataFrame) -> DataFrame:
    """Drop explicit zeros."""
    return entries.where(F.col("v") != 0)


def gram(entries: DataFrame, rank: int) -> DataFrame:
    """MᵀM of a tall matrix with ``rank`` columns, as entries, through factor form."""
    from blockweave.operators import factor

    return factor.gram_entries(factor.from_entries(entries, rank), rank)
