"""Where scratch tables go, and what becomes of them."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from claimloom import scratch


def session(master, named=None):
    conf = SimpleNamespace(get=lambda k, d=None: named)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_folder():
    assert scratch.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch.shared_dir(session("local[2]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            scratch.shared_dir(session(master))


def test_cut_observes_and_drops(spark):
    s = scratch.Scratch(spark, "test")
    t = s.cut(spark.range(10), "ids", n=F.count("*"), most=F.max("id"))
    assert s.seen == {"n": 10, "most": 9} and t.count() == 10
    path = t._claimloom_path.removeprefix("file://")
    assert os.path.isdir(path)
    s.drop(t)
    assert not os.path.exists(path)
