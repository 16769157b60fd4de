import pytest

from blockweave import session


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, context, wanted=None):
        self.sparkContext = context
        self.conf = self
        self.wanted = wanted

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.wanted or default


def test_checkpoint_folder_of_the_session_comes_first():
    assert session.checkpoint_dir(FakeSession(FakeContext("spark://x", "/shared/a"), "/shared/b")) == "/shared/a"
    assert session.checkpoint_dir(FakeSession(FakeContext("spark://x"), "/shared/b")) == "/shared/b"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(FakeSession(FakeContext("spark://x")))


def test_cut_drops_the_lineage(spark):
    df = session.cut(spark.range(10).selectExpr("id % 3 as k").groupBy("k").count())
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 3
