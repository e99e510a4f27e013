"""Where intermediate tables are written."""

from types import SimpleNamespace

import pytest

from vocalith.plans.scratch import shared_dir


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_cluster_needs_a_shared_folder():
    assert shared_dir(session("spark://host:7077", "hdfs://store/x/")) == "hdfs://store/x"
    assert shared_dir(session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
