from types import SimpleNamespace

import pytest

from duskwatch import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_folder_of_the_cluster_is_used():
    assert session.stage_path(fake("yarn", "hdfs:///ckpt/"), "x").startswith("hdfs:///ckpt/duskwatch/app-1/x-")


def test_a_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_dir(fake("spark://host:7077"))


def test_a_local_session_has_one_own_folder():
    assert session.shared_dir(fake("local[2]")) == session.shared_dir(fake("local[2]"))


def test_staged_tables_keep_rows_and_schema(spark):
    df = spark.createDataFrame([(1, {"a": "b"}), (2, None)], "i bigint, m map<string,string>")
    got = session.stage(df, "t")
    assert got.dtypes == df.dtypes and got.count() == 2
    assert session.broadcast_if_small(df, 2) is not df
    assert session.broadcast_if_small(df, 1) is df
