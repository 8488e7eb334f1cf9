"""Written tables: where they go, and when they go."""

import os

import pytest

from sonorel import storage


class Elsewhere:
    """A session of a cluster, as far as shared_dir asks."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default: folder)})


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(Elsewhere(master))
        assert storage.shared_dir(Elsewhere(master, "hdfs://n/x/")) == "hdfs://n/x"


def test_tables_are_written_and_cleared(spark):
    df = storage.materialize(spark.range(5), "five")
    assert df.count() == 5
    folder = storage.tables_dir(spark).removeprefix("file://")
    assert os.listdir(folder)
    storage.clear_tables(spark)
    assert not os.path.exists(folder)
