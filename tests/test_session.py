"""Staging: where tables go, that a cluster without a shared folder is refused, and that they can be removed."""

import os

import pytest

from logloom import session


class _Cluster:
    """A session of a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(dict)


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster)


def test_staged_tables_are_removed(spark):
    session.clear_staged(spark)
    kept = session.staged(spark.range(5), "test")
    assert kept.count() == 5
    folder = session.shared_dir(spark).removeprefix("file://")
    assert any(x.startswith("logloom-test-") for x in os.listdir(folder))
    assert session.clear_staged(spark) == 1
    assert not any(x.startswith("logloom-test-") for x in os.listdir(folder))
