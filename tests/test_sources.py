import bz2

import pytest
from pyspark.errors import PySparkException

from blockweave.functions.columns import argmax
from blockweave.operators import entry
from blockweave.sources import libsvm, ratings


def test_ratings_file_with_more_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,7,3.5,99\n2,7,1,98\n1,7,0.5,97\n")
    df = ratings.read_ratings(spark, str(tmp_path / "r.csv"), partitions=3)
    assert df.dtypes == [("userId", "bigint"), ("movieId", "bigint"), ("rating", "double")]
    assert df.rdd.getNumPartitions() == 3
    got = entry.sum_duplicates(ratings.rating_entries(df)).collect()
    assert sorted(map(tuple, got)) == [(1, 7, 4.0), (2, 7, 1.0)]


def test_columns_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text("when,stars,film,who\n1,4.5,2,3\n")
    df = ratings.read_ratings(spark, str(tmp_path / "r.csv"), user="who", item="film", rating="stars")
    assert tuple(df.first()) == (3, 2, 4.5)


def test_bad_rating_stops(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating\n1,7,good\n")
    with pytest.raises(PySparkException):
        ratings.read_ratings(spark, str(tmp_path / "r.csv")).collect()


def test_only_needed_columns_are_parsed(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,7,3.5,99\n")
    plan = ratings.read_ratings(spark, str(tmp_path / "r.csv"))._jdf.queryExecution().toString()
    assert "timestamp" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_ratings_round_trip(spark, tmp_path, compression):
    e = spark.createDataFrame([(1, 2, 0.1), (3, 4, 1e-17)], "i bigint, j bigint, v double")
    ratings.write_ratings(e, str(tmp_path / "out"), compression=compression)
    back = ratings.rating_entries(ratings.read_ratings(spark, str(tmp_path / "out")))
    assert sorted(back.collect()) == sorted(e.collect())


def test_libsvm_bz2(spark, tmp_path):
    path = tmp_path / "s.bz2"
    path.write_bytes(bz2.compress(b"3 1:0.5 4:2\n0 2:-1\n"))
    df = libsvm.read_libsvm(spark, str(path), 5)
    got = sorted((r["label"], r["features"].toArray().tolist()) for r in df.collect())
    assert got == [(0.0, [0, -1, 0, 0, 0]), (3.0, [0.5, 0, 0, 2, 0])]
    pairs = libsvm.training_pairs(df, 4)
    labels = sorted(r[0] for r in pairs.select(argmax(pairs.target)).collect())
    assert labels == [0.0, 3.0]


def test_libsvm_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 0.1, 3.0]), (2, [0.0, 0.0, 0.0])], "label int, features array<double>")
    libsvm.write_libsvm(df, str(tmp_path / "out"))
    back = libsvm.read_libsvm(spark, str(tmp_path / "out"), 3)
    got = sorted((r["label"], r["features"].toArray().tolist()) for r in back.collect())
    assert got == [(1.0, [0.0, 0.1, 3.0]), (2.0, [0.0, 0.0, 0.0])]


def test_empty_rating_fields_stop_the_job(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating\n1,2,3\n,2,3\n")
    with pytest.raises(PySparkException, match="empty field in column userId"):
        ratings.read_ratings(spark, str(tmp_path / "r.csv")).collect()
