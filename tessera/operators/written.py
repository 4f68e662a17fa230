"""Intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOTS: set[str] = set()


def clear_written(spark: SparkSession) -> None:
    """Deletes the tables of all operator calls of this driver, once their results have been read or written."""
    while _ROOTS:
        _remove(spark, _ROOTS.pop())


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Written:
    """Tables of one operator call, as Parquet under the session's ``spark.checkpoint.dir``.

    A written table is computed once, whoever reads it, and outlives the executors that wrote it.
    Only a local master (tests) may go without the setting and then gets a temporary folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        conf = spark.sparkContext.getConf()
        base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not (conf.get("spark.master", "") or "").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _ROOTS.add(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there and not empty; its first entry is all that is asked for."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(path) and system.listStatusIterator(path).hasNext()


#: A key that a thousandth of all rows have is hot; there can be no more than a thousand of them.
HOT_SHARE = 1000


def join_folded(rows: DataFrame, folded: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many rows a key with the one row of ``folded`` that says in ``size`` how many of ``total`` those are.

    The rows of hot keys stay where they are and meet a broadcast of their few folded rows; no task gathers a
    key of more than a HOT_SHARE-th of all rows.
    """
    hot = F.broadcast(folded.where(F.col(size) * HOT_SHARE >= total))
    cold = folded.where(F.col(size) * HOT_SHARE < total)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))
