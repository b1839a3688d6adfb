"""Parquet tables of a data directory, and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Names the version of each table; swapped as a whole.
POINTER = "tables.json"


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``data_dir`` (one file or a folder of part files), in its current version."""
    where = current(spark, data_dir).get(name, [f"{name}.parquet"])
    return spark.read.option("mergeSchema", len(where) > 1).parquet(*(f"{data_dir}/{x}" for x in where))


def current(spark: SparkSession, data_dir: str) -> dict[str, list[str]]:
    """Where the published tables of ``data_dir`` lie, by name; empty where nothing has been published."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/{POINTER}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    return json.loads(spark.read.text(f"{data_dir}/{POINTER}", wholetext=True).head()[0])


def exists(spark: SparkSession, data_dir: str, name: str) -> bool:
    """Whether ``data_dir`` holds the table, published or as it came."""
    if name in current(spark, data_dir):
        return True
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset, one of our own."""
    sc = spark.sparkContext
    if not (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliograph-"))
    return sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs nothing but a re-read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # holds the frames, so that no id is given twice

    def put(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns it as read from there."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Deletes the files of a table that put() returned and nothing reads any more."""
        if df is not None and (held := self.paths.pop(id(df), None)):
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(held[1])
            p.getFileSystem(conf).delete(p, True)
