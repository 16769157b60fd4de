import pathlib
import sys

import numpy as np
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from blockweave.session import build_session  # noqa: E402

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def entries_of(spark, matrix, partitions=3):
    """The non-zero cells of a numpy matrix as an entry table."""
    i, j = np.nonzero(matrix)
    rows = [(int(a), int(b), float(matrix[a, b])) for a, b in zip(i, j, strict=True)]
    return spark.createDataFrame(rows, "i bigint, j bigint, v double").repartition(partitions)


def matrix_of(entries, shape):
    out = np.zeros(shape)
    seen = set()
    for r in entries.collect():
        assert (r["i"], r["j"]) not in seen
        seen.add((r["i"], r["j"]))
        out[r["i"], r["j"]] = r["v"]
    return out


def factor_of(spark, matrix):
    rows = [(n, [float(x) for x in row]) for n, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id bigint, f array<double>").repartition(3)


def matrix_of_factor(factor, rows):
    got = {r["id"]: r["f"] for r in factor.collect()}
    assert sorted(got) == list(range(rows))
    return np.array([got[n] for n in range(rows)])
