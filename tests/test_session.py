"""Durable cuts of the lineage."""

import os

import pytest

from tallyloom import session


def test_cut_keeps_rows_and_is_dropped(spark):
    table = session.write_cut(spark.range(10).selectExpr("id", "array(id) as a"), "t")
    path = table.path.removeprefix("file://")
    assert table.read().count() == 10 and os.path.isdir(path)
    assert "Range" not in table.read()._jdf.queryExecution().optimizedPlan().toString()
    table.drop()
    assert not os.path.exists(path)


class Fake:
    """As much of a session as the choice of the folder reads."""

    def __init__(self, master, **conf):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, *d: conf.get(k, *d))})


def test_where_cuts_are_written():
    setting = {"spark.checkpoint.dir": "hdfs:///shared/"}
    assert session.checkpoint_root(Fake("local[2]", **setting)) == session.checkpoint_root(Fake("spark://m:7077", **setting)) == "hdfs:///shared"
    assert session.checkpoint_root(Fake("yarn", **{"spark.sql.warehouse.dir": "hdfs:///w"})) == "hdfs:///w/tallyloom-cuts"
    for own in ("file:/w/", "/w", ""):
        with pytest.raises(ValueError):
            session.checkpoint_root(Fake("local-cluster[2,1,1024]", **{"spark.sql.warehouse.dir": own}))
    assert session.checkpoint_root(Fake("local[*]")).startswith("file:///")
