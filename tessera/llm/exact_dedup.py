"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. A batch is digested and folded to one
candidate a digest, which is written in the index's buckets; a sort-merge anti-join of the
two, which shuffles nothing, leaves the new digests, and these are appended under the batch's
name. Only folded digests and ids are shuffled; texts never are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, ascii_lower, join_folded, listed, read_table, remove, shared_dir

#: Batches in which a table is handed to its index, from the largest ids down.
BATCHES = 2


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 after lower-casing A-Z; null counts as the empty text."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Digests seen so far, each with the id of the row that was kept for it and its batch.

    The table's files lie in ``folder``, by default in the shared folder, and outlive the session: one that
    does not know the table registers it from them. Their folder's name says the number of buckets.
    """

    def __init__(self, spark: SparkSession, table: str, id_type: str = "bigint", buckets: int | None = None, folder: str | None = None):
        self.spark, self.table = spark, table
        self.folder = (folder or f"{shared_dir(spark)}/digest-index").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if spark.catalog.tableExists(table):
            found = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(found["data_type"]) if found else self.buckets
            return
        there = [name.rsplit("-", 1)[1] for name in listed(spark, self.folder) if name.rsplit("-", 1)[0] == table]
        if there:
            self.buckets = int(there[0])
            columns = f"digest binary, keep_id {id_type}, batch string"
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._at(table)}'")
        else:
            self._write(spark.createDataFrame([], f"digest binary, keep_id {id_type}, batch string"), table)

    def _at(self, table: str) -> str:
        return f"{self.folder}/{table}-{self.buckets}"

    def _write(self, df: DataFrame, table: str) -> None:
        (
            df.repartition(self.buckets, "digest")
            .write.mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .option("path", self._at(table))
            .saveAsTable(table)
        )

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, self._at(table))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def fold(self, staged: DataFrame, batch: str) -> DataFrame:
        """digest, keep_id, keep_row (null for texts of other batches) and group_size of (doc_id, digest, row).

        The batch's new digests are in the index afterwards. A batch that was stopped at any
        point can be handed in again under its name: what it had appended is its own.
        """
        scratch, folded = Scratch(self.spark, "dedup"), f"{self.table}_{uuid.uuid4().hex}"
        groups = staged.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
        )
        try:
            # Written before the join, which the optimizer would else push below the fold.
            self._write(groups, folded)
            return self._settled(self.spark.table(folded), batch, scratch)
        finally:
            self._drop(folded)

    def _settled(self, groups: DataFrame, batch: str, scratch: Scratch) -> DataFrame:
        seen = self.rows().select("digest", F.col("keep_id").alias("seen_id"), F.col("batch").alias("seen_batch"))
        earlier = seen.where(F.col("seen_batch") != batch)
        fresh = groups.join(earlier.hint("merge"), "digest", "left_anti")
        known = groups.join(earlier.hint("merge"), "digest")
        both = fresh.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size").unionByName(
            known.select("digest", F.col("seen_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "group_size")
        )
        both = scratch.save(both, "groups")
        new = fresh.join(seen.hint("merge"), "digest", "left_anti")
        self._write(new.select("digest", F.col("best.doc_id").alias("keep_id"), F.lit(batch).alias("batch")), self.table)
        return both

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicates ``docs`` against itself and the index, then appends its new digests.

        One row for each row of ``docs``: doc_id, keep_id, group_size (rows of the batch with
        that text), kept, digest. Of equal texts the largest id stays; of equal ids (repeated
        rows) exactly one row stays; null ids come before all others. A text already in the
        index keeps no row, and keep_id is the id kept then. Null text counts as empty. A batch
        that is handed in again under its name gets the same answer.
        """
        staged = _staged(self.spark, docs, id_col, text_col)
        return _spread(staged, self.fold(staged, batch or uuid.uuid4().hex))

    def compact(self) -> None:
        """Rewrites the index with one sorted file a bucket, after many batches.

        Its rows are written to ``<table>_whole`` first. What a stopped call left there comes back before
        anything else is done.
        """
        rest = DigestIndex(self.spark, f"{self.table}_whole", dict(self.rows().dtypes)["keep_id"], self.buckets, self.folder)
        lost = rest.rows().join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        if not lost.isEmpty():
            self._write(Scratch(self.spark, "dedup").save(lost, "lost"), self.table)
        rest.drop()
        rest._write(self.rows(), rest.table)
        self.drop()
        self._write(rest.rows(), self.table)
        rest.drop()

    def drop(self) -> None:
        self._drop(self.table)


def _staged(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and a number of each row of ``docs``, written."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")
    )
    return Scratch(spark, "dedup").save(rows, "staged")


def _spread(staged: DataFrame, groups: DataFrame) -> DataFrame:
    """Each staged row with its group's keep_id, group_size and whether it is the row kept."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    both = join_folded(staged, groups, "digest", "group_size", total)
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def _indexed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` through a new index in BATCHES batches, cut at quantiles of numeric ids, the largest ids first.

    So a later batch's texts that an earlier one holds are dropped by the index; sizes are added up.
    """
    kind = dict(docs.dtypes)["doc_id"]
    staged = _staged(spark, docs)
    cuts: list = []
    if not kind.startswith(("string", "binary")):
        at = [k / BATCHES for k in range(BATCHES - 1, 0, -1)]
        found = staged.agg(F.percentile_approx("doc_id", at).alias("cuts")).first()["cuts"]
        cuts = sorted(set(found or []), reverse=True)
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", kind)
    rest, groups = staged, None
    try:
        for k, cut in enumerate([*cuts, None]):
            part = rest if cut is None else rest.where(F.col("doc_id") >= cut)
            rest = rest if cut is None else rest.where(F.col("doc_id").isNull() | (F.col("doc_id") < cut))
            found = index.fold(part, f"batch-{k}")
            groups = found if groups is None else groups.unionByName(found)
    finally:
        index.drop()
    if cuts:
        groups = groups.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"), F.sum("group_size").alias("group_size")
        )
        groups = Scratch(spark, "dedup").save(groups, "all-groups")
    return _spread(staged, groups)


def dedup_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` through a new index, in batches from the largest ids down.

    doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty; an empty table
    gives no rows; other columns are ignored.
    """
    return _indexed(spark, docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest doc_id.

    All columns stay. Of fully repeated rows one stays. The join key holds the id, so a text
    that a third of all rows share is spread over all tasks.
    """
    key = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_key"), F.col(c).isNull().alias("_none")]
    keep = _indexed(spark, docs).where("kept").select(*key("doc_id"), F.col("digest").alias("_digest"))
    marked = docs.select(F.struct("*").alias("_row"), *key("doc_id"), text_digest(F.col("text")).alias("_digest"))
    found = marked.join(keep.hint("merge"), ["_key", "_none", "_digest"], "left_semi")
    # Repeated rows meet in one task here already; a row number among them needs no other shuffle.
    order = Window.partitionBy("_key", "_none", "_digest").orderBy(F.lit(1))
    return found.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(spark, read_table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
