"""Where intermediate tables go."""

import pytest

from beckon.session import scratch_path


class FakeContext:
    def __init__(self, master, checkpoint=None):
        self.master, self.checkpoint = master, checkpoint

    def getCheckpointDir(self):
        return self.checkpoint


class FakeSession:
    def __init__(self, master, shared=None, checkpoint=None):
        self.sparkContext = FakeContext(master, checkpoint)
        self.conf = {"spark.checkpoint.dir": shared} if shared else {}


def test_shared_folder_is_used():
    assert scratch_path(FakeSession("spark://h:7077", "hdfs:///x/"), "a").startswith("hdfs:///x/beckon/a-")
    assert scratch_path(FakeSession("yarn", None, "hdfs:///c"), "a").startswith("hdfs:///c/beckon/a-")


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(FakeSession(master), "a")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_temporary_folder_on_one_machine(master):
    assert "beckon-" in scratch_path(FakeSession(master), "a")
