import pytest

from orefield.session import new_workspace, shared_root


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    def set(self, key, value):
        self[key] = value


class Session:
    """Just the parts of a session that shared_root looks at."""

    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = self
        self.master = master

    def setCheckpointDir(self, path):
        self.dir = path


def test_the_cluster_names_the_shared_folder():
    session = Session("yarn", **{"spark.checkpoint.dir": "hdfs://x/ckpt/"})
    assert shared_root(session) == "hdfs://x/ckpt"
    one, two = new_workspace(session, "a"), new_workspace(session, "a")
    assert one != two and one.startswith("hdfs://x/ckpt/orefield/a-")


def test_a_cluster_without_one_is_refused():
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_root(Session("spark://host"))


def test_a_local_session_gets_its_own():
    session = Session("local[2]")
    assert shared_root(session) == session.dir == shared_root(session)
