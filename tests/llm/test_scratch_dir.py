from types import SimpleNamespace

import pytest

from sparkloom.llm.common import scratch_dir


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_shared_folder_comes_first():
    assert scratch_dir(session("spark://host:7077", "hdfs://shared")).startswith("hdfs://shared")
    assert scratch_dir(session("local[2]", "/shared")).startswith("/shared")


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8, 3]"])
def test_one_process_may_take_its_own(master):
    assert scratch_dir(session(master)).startswith("file:///")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        scratch_dir(session(master))
