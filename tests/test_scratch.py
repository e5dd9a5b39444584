"""Where tables between jobs go."""

from types import SimpleNamespace

import pytest

from telemill.sources import scratch


def session(master, **conf):
    conf = {k.replace("_", "."): v for k, v in conf.items()}  # no setting has an underscore
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: conf[k] if k in conf else d[0]), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{id(conf)}"))


def test_the_named_folder_comes_first():
    assert scratch.shared_folder(session("yarn", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"


def test_a_cluster_needs_a_shared_folder():
    assert scratch.shared_folder(session("yarn", spark_sql_warehouse_dir="hdfs://a/w")) == "hdfs://a/w"
    for where in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.shared_folder(session("local-cluster[2,1,1024]", spark_sql_warehouse_dir=where))


def test_one_machine_takes_a_temporary_folder():
    s = session("local[4]")
    assert scratch.shared_folder(s) == scratch.shared_folder(s)
