import random

from pyspark.sql import functions as F

from blockweave.operators import numbering


def test_numbers_follow_the_order(spark):
    ids = random.Random(2).sample(range(-(10**15), 10**15), 3000)
    df = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "id bigint").repartition(7)
    got = {r["id"]: r["number"] for r in numbering.number_ids(df, "id").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}


def test_there_and_back(spark):
    rows = [(10**12 * n, f"v{n}") for n in range(50)] + [(None, "lost")]
    df = spark.createDataFrame(rows, "user bigint, v string").repartition(4)
    numbers = numbering.number_ids(df, "user")
    dense = numbering.to_numbers(df, "user", numbers)
    assert dense.columns == ["user", "v"]
    assert sorted(r["user"] for r in dense.collect()) == list(range(50))
    assert sorted(tuple(r) for r in numbering.to_ids(dense, "user", numbers).collect()) == sorted(rows[:-1])


def test_equal_rows_strings_and_empty(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "id string").repartition(3)
    got = sorted(((r["number"], r["id"]) for r in numbering.numbered(df, F.asc_nulls_first("id")).collect()))
    assert got == [(0, None), (1, "a"), (2, "b"), (3, "b")]
    assert numbering.numbered(df.limit(0), "id").collect() == []
