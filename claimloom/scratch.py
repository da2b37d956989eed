"""Shared-folder scratch tables: the lineage cuts of iterative and multi-pass operators.

A cut is an ordinary Parquet table below the folder the session names in
``spark.checkpoint.dir``.  Every executor sees that folder, so a lost executor
loses nothing, and unlike ``checkpoint()`` a written table is computed once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where none is set, a session whose executors live in the driver (``local[n]``, as in tests) gets a folder
    of its own; any other session is refused, for a folder of one machine would lose rows on the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="claimloom-")
    return _own


_own: str | None = None


class Scratch:
    """Tables of one operator run.

    Superseded ones are dropped as the run goes on (:meth:`drop`); what the
    result still reads is deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex[:12]}"
        self.number = 0
        #: aggregates asked for in the last :meth:`cut`
        self.seen: dict = {}

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame, tag: str = "t", **observe: Column) -> DataFrame:
        """Write ``df`` once and return a scan of what was written.

        ``observe`` are aggregates taken of the rows while they are written; they are in ``seen`` afterwards.
        """
        if not self.number:
            root, fs = self._path(self.root)
            fs.deleteOnExit(root)
        self.number += 1
        path = f"{self.root}/{self.number:04d}-{tag}"
        watch = Observation() if observe else None
        rows = df.observe(watch, *(c.alias(k) for k, c in observe.items())) if watch else df
        rows.write.mode("overwrite").parquet(path)
        self.seen = watch.get if watch else {}
        out = self.spark.read.schema(df.schema).parquet(path)
        out._claimloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by :meth:`cut` that nothing reads any more."""
        for df in tables:
            path, fs = self._path(df._claimloom_path)
            fs.delete(path, True)
