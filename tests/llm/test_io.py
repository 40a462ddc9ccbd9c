import os
from types import SimpleNamespace

import pytest

from axisloom.llm import _io, _worker


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder or other), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("local", "local[8]", "local[*]", "local[4, 2]"):
        assert _io.shared_dir(session(master)).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            _io.shared_dir(session(master))
        assert _io.shared_dir(session(master, "hdfs://shared/")) == "hdfs://shared"


def test_tables_are_dropped(spark, tmp_path):
    df = _io.table(spark.range(5), "numbers")
    path = df._shared_path.removeprefix("file://")
    assert df.count() == 5 and os.listdir(path)
    _io.drop_table(df)
    assert not os.path.exists(path)


def test_a_worker_keeps_the_state_of_one_operator():
    first = _worker.state("one")
    first["big"] = bytes(10)
    assert _worker.state("one") is first
    assert _worker.state("two") == {} and _worker.state("one") == {}
