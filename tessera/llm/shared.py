"""Shared folders, intermediate tables and table reading for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key held by at least one row in so many is hot; there can be no more hot keys than this.
HOT_SHARE = 1000
#: Rows of one key that meet its row in one task, and tasks that a hot key is spread over at most.
SPREAD_ROWS, SPREAD_WAYS = 256, 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` decides. Only a local master (tests) may go
    without it and then gets a temporary folder; a cluster without it is an error, since a
    machine-local folder would lose files there.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not (conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder with all that is in it, if it is there."""
    system, path = _file_system(spark, folder)
    system.delete(path, True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    system, path = _file_system(spark, folder)
    return [status.getPath().getName() for status in system.listStatus(path)] if system.exists(path) else []


_ROOTS: set[str] = set()


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all operator calls of this driver, once their results have been read or written."""
    while _ROOTS:
        remove(spark, _ROOTS.pop())


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts the lineage and outlives the executors that wrote it. ``drop``
    removes tables that no returned DataFrame reads any more, ``clear_scratch`` all that are left.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.add(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null stays null.

    ``lower`` does the same, and faster, where every character takes one byte.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def join_folded(rows: DataFrame, folded: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of many rows a key with one of ``folded``, whose ``size`` of ``total`` rows the key has.

    At most HOT_SHARE keys have a HOT_SHARE-th of the rows each; these are broadcast, so no key
    gathers more than that in one task.
    """
    hot = F.broadcast(folded.where(F.col(size) * HOT_SHARE >= total))
    cold = folded.where(F.col(size) * HOT_SHARE < total)
    rest = rows.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold.hint("merge"), key))


def join_spread(rows: DataFrame, wide: DataFrame, key: str, by: str, keys: DataFrame) -> DataFrame:
    """Inner join of many rows a key with one wide row of ``wide``, too wide to broadcast.

    ``keys`` has the key of every row. The rows of a hot key are dealt by ``by`` over several
    tasks, each with a copy of its wide row: one for SPREAD_ROWS rows.
    """
    total = keys.count()
    hot = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") > SPREAD_ROWS) & (F.col("_rows") * HOT_SHARE >= total))
    ways = F.least(F.ceil(F.col("_rows") / SPREAD_ROWS), F.lit(SPREAD_WAYS)).cast("int")
    hot = F.broadcast(hot.select(key, ways.alias("_ways")))
    own = F.coalesce(F.pmod(F.xxhash64(by), F.col("_ways")), F.lit(0)).cast("int")
    left = rows.join(hot, key, "left").withColumn("_way", own).drop("_ways")
    all_ways = F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1)
    right = wide.join(hot, key, "left").withColumn("_way", F.explode(all_ways)).drop("_ways")
    return left.join(right, [key, "_way"]).drop("_way")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts in UTF-8, by one pass over them."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


#: SQL for the table ``t`` (t) of CRC-32: what each byte adds, by the format's fixed polynomial.
CRC_TABLE = """t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"""


def crc32_sql(digits: str) -> str:
    """SQL for the CRC-32 of bytes in hexadecimal, where ``t`` is at hand."""
    byte = f"list_transform(regexp_extract_all({digits}, '..'), lambda d: ('0x' || d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
