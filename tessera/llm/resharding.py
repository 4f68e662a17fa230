"""Resharding by minimum-cost flow: block transfers that move the fewest bytes.

Old shards and their sizes are the sources of a network, new shards and their capacities its
sinks; a byte that stays costs nothing and one that moves costs its way. The cheapest flow says
how many bytes each old shard gives to each new one. An old shard is laid out in a total order and
cut where the flow says: the blocks between cuts are what is transferred, equal texts lie
side by side in them. Files without a transferred row are never rewritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import CRC_TABLE, Scratch, crc32_sql, read_table

#: Shards of the query before and after.
OLD_SHARDS, NEW_SHARDS = 12, 16
#: A group of equal texts of less than so small a share of a shard is not cut.
WHOLE_SHARE = 1000


def cheapest_flow(sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes that old shard i gives to new shard j, of least total cost; all bytes are given.

    Successive shortest paths: each round sends what fits along the cheapest way, which may take
    back earlier flow. The network has a node a shard, whatever the data.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError(f"{sum(sizes)} bytes do not fit into {sum(capacities)}")
    m, n = len(sizes), len(capacities)
    source, sink = m + n, m + n + 1
    ends: list[list[int]] = []  # from, to, room, cost; edge e ^ 1 goes back
    at: list[list[int]] = [[] for _ in range(m + n + 2)]

    def edge(a: int, b: int, room: int, price: int) -> None:
        for end in ([a, b, room, price], [b, a, 0, -price]):
            at[end[0]].append(len(ends))
            ends.append(end)

    for i, size in enumerate(sizes):
        edge(source, i, size, 0)
    for i in range(m):
        for j in range(n):
            edge(i, m + j, sizes[i], cost(i, j))
    for j, room in enumerate(capacities):
        edge(m + j, sink, room, 0)
    while True:
        price: list[float] = [float("inf")] * len(at)
        via, queue = [-1] * len(at), [source]
        price[source] = 0
        while queue:
            later = []
            for a in queue:
                for e in at[a]:
                    _, b, room, extra = ends[e]
                    if room and price[a] + extra < price[b]:
                        price[b], via[b] = price[a] + extra, e
                        later.append(b)
            queue = later
        if via[sink] < 0:
            break
        way, node = [], sink
        while node != source:
            way.append(via[node])
            node = ends[via[node]][0]
        sent = min(ends[e][2] for e in way)
        for e in way:
            ends[e][2] -= sent
            ends[e ^ 1][2] += sent
    return {(a, b - m): ends[k ^ 1][2] for k, (a, b, _, _) in enumerate(ends) if k % 2 == 0 and a < m and ends[k ^ 1][2]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def laid_out(spark: SparkSession, rows: DataFrame, order: Sequence[Column], scratch: Scratch) -> DataFrame:
    """Adds ``rank`` (rows) and ``offset`` (bytes) of what comes before each row of (shard, size, ...) in its shard.

    A range sort by shard and ``order``: each task sums up its own rows, and the sums of tasks, a row a
    task and shard, give the rest. No task holds more than a range.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("shard"), *order]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    names = [*ranged.columns, "rank", "offset"]
    at = [ranged.columns.index(c) for c in ("shard", "size")]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ranks, offsets = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in at)
            if shard[0] != last:
                ranks = offsets = 0
            first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            upto = np.concatenate(([0], np.cumsum(size)))
            runs = np.diff(np.append(first, len(shard)))
            rank = np.arange(len(shard)) - np.repeat(first, runs)
            offset = upto[:-1] - np.repeat(upto[first], runs)
            rank[: runs[0]] += ranks
            offset[: runs[0]] += offsets
            last, ranks, offsets = shard[-1], int(rank[-1]) + 1, int(offset[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64()), pa.array(offset, pa.int64())], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes) + ", rank bigint, offset bigint"
    ranged = scratch.save(ranged.mapInArrow(sums, schema), "ranged")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    tasks = ranged.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    tasks = tasks.select("shard", "part", total("rows").alias("_rank"), total("bytes").alias("_offset"))
    found = ranged.join(F.broadcast(tasks), ["shard", "part"])
    return found.select(*rows.columns, (F.col("rank") + F.col("_rank")).alias("rank"), (F.col("offset") + F.col("_offset")).alias("offset"))


def _cuts(flow: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int, int]]]:
    """(new shard, from, to) of each old shard's blocks; what stays comes first."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (i, j), size in sorted(flow.items(), key=lambda f: (f[0][0], f[0][0] != f[0][1], f[0][1])):
        low = out[i][-1][2] if i in out else 0
        out.setdefault(i, []).append((j, low, low + size))
    return out


def _between_groups(spark: SparkSession, rows: DataFrame, cuts: dict[int, list[tuple[int, int, int]]], most: int) -> dict[int, list[tuple[int, int, int]]]:
    """The blocks with each cut that falls into a group of ``most`` bytes at most moved to the group's nearer end.

    What is gathered is a group a cut.
    """
    inner = [(i, high) for i, blocks in cuts.items() for _, _, high in blocks[:-1]]
    if not inner:
        return cuts
    marks = F.broadcast(spark.createDataFrame(inner, "shard int, cut long"))
    hit = rows.join(marks, "shard").where("offset < cut AND cut < offset + size OR offset = cut").select("shard", "cut", "group").distinct()
    groups = rows.join(F.broadcast(hit), ["shard", "group"]).groupBy("shard", "cut").agg(F.min("offset").alias("low"), F.max(F.col("offset") + F.col("size")).alias("high"))
    moved = {(r["shard"], r["cut"]): (r["low"] if r["cut"] - r["low"] <= r["high"] - r["cut"] else r["high"]) for r in groups.collect() if r["high"] - r["low"] <= most}
    out = {}
    for i, blocks in cuts.items():
        ends = [0, *[moved.get((i, high), high) for _, _, high in blocks[:-1]], blocks[-1][2]]
        out[i] = [(j, max(ends[: k + 1]), max(ends[: k + 2])) for k, (j, _, _) in enumerate(blocks)]
    return out


def assign(spark: SparkSession, rows: DataFrame, order: Sequence[Column], capacities: Sequence[int] | int, group: str | None = None, cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> DataFrame:
    """Adds ``new_shard`` and ``slot`` (place in it, gapless from 0) to each row of (shard, size, ...).

    ``capacities``: bytes of each new shard, or a number of shards of equal ones. Each new shard gets its
    part of the cheapest flow, up to half of the row at each cut, which goes where its middle lies; with ``group``, rows of one value that
    ``order`` puts side by side are cut only if they hold a WHOLE_SHARE-th of a shard. Sizes and
    shards are not null and sizes are not negative. Repeated rows count each; an empty table
    gives no rows. Reruns agree but for rows that ``order`` cannot tell apart.
    """
    scratch = Scratch(spark, "reshard")
    placed = scratch.save(laid_out(spark, rows.withColumn("group", F.col(group)) if group else rows, order, scratch), "placed")
    scratch.drop("ranged")
    sizes = {r["shard"]: r["bytes"] for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    old = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    room = equal_capacities(sum(old), capacities) if isinstance(capacities, int) else list(capacities)
    cuts = _cuts(cheapest_flow(old, room, cost))
    if group:
        cuts = _between_groups(spark, placed, cuts, max(room, default=0) // WHOLE_SHARE)
    blocks = [(i, j, low, high) for i, parts in cuts.items() for j, low, high in parts if low < high]
    # Rows of no bytes lie where the next block begins, or at the very end.
    last = {i: max(b[3] for b in blocks if b[0] == i) for i in {b[0] for b in blocks}}
    blocks = [(i, j, low, high if high < last[i] else high + 1) for i, j, low, high in blocks] + [(i, i % len(room), 0, 1) for i in sizes if i not in last]
    table = F.broadcast(spark.createDataFrame(blocks, "shard int, new_shard int, low long, high long"))
    found = placed.join(table, "shard").where("2 * low <= 2 * offset + size AND 2 * offset + size < 2 * high").drop("low", "high")
    counts = {(r["shard"], r["new_shard"]): (r["first"], r["rows"]) for r in found.groupBy("shard", "new_shard").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("rows")).collect()}
    shifts, filled = [], {}
    for (i, j), (first, number) in sorted(counts.items()):
        shifts.append((i, j, filled.get(j, 0) - first))
        filled[j] = filled.get(j, 0) + number
    table = F.broadcast(spark.createDataFrame(shifts, "shard int, new_shard int, shift long"))
    found = found.join(table, ["shard", "new_shard"]).withColumn("slot", F.col("rank") + F.col("shift"))
    return found.select(*rows.columns, "new_shard", "slot")


def text_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, none for null, and one for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def rewrite(spark: SparkSession, folder: str, shards: int) -> dict[str, int]:
    """Makes ``folder``'s Parquet files, in folders ``shard=K``, hold ``shards`` shards of near equal bytes of text.

    Rows keep their files' order; only files that give a row away are read again and replaced. New files
    are written beside the shards first, then a manifest of all renames and deletions, and only then are
    these done: a rewrite that was stopped is undone or finished by the next call. Returns
    the numbers of files replaced and of all files before.
    """
    fs, path = _file_system(spark, folder)
    finish(spark, folder)
    docs = spark.read.parquet(folder)
    rows = docs.select("_metadata.file_path", "_metadata.row_index", F.col("shard").cast("int").alias("shard"), text_size(F.col("text")).alias("size"))
    scratch = Scratch(spark, "rewrite")
    order = [F.col("file_path"), F.col("row_index")]
    found = scratch.save(assign(spark, rows, order, shards), "assigned")
    files = found.groupBy("file_path").agg(F.max((F.col("shard") != F.col("new_shard")).cast("int")).alias("moved"))
    # One name a file: what is gathered is a listing of the folder.
    listed = files.collect()
    old = [r["file_path"] for r in listed if r["moved"]]
    if old:
        name = f"_reshard-{uuid.uuid4().hex}"
        affected = spark.read.option("basePath", folder).parquet(*old)
        columns = [c for c in affected.columns if c != "shard"]
        marked = affected.select(*columns, F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.row_index").alias("_row_index"))
        to = found.select(F.col("file_path").alias("_file_path"), F.col("row_index").alias("_row_index"), "new_shard", "slot")
        moved = marked.join(to, ["_file_path", "_row_index"]).select(*columns, F.col("new_shard").alias("shard"), "slot")
        moved = moved.repartitionByRange(max(len(old), shards), "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot")
        moved.write.partitionBy("shard").parquet(f"{folder}/{name}")
        staged = [str(s.getPath().toString()) for d in fs.listStatus(path(f"{folder}/{name}")) if d.isDirectory() for s in fs.listStatus(d.getPath())]
        plan = {"staged": name, "renames": [[s, f"{folder}/{s.split(f'/{name}/')[1]}"] for s in staged], "deletions": old}
        out = fs.create(path(f"{folder}/_reshard-manifest.tmp"), True)
        out.write(bytearray(json.dumps(plan).encode()))
        out.close()
        fs.rename(path(f"{folder}/_reshard-manifest.tmp"), path(f"{folder}/_reshard-manifest"))
        finish(spark, folder)
    scratch.drop("assigned")
    return {"replaced": len(old), "files": len(listed)}


def finish(spark: SparkSession, folder: str) -> None:
    """Does what a manifest in the folder says, as far as it is not done yet, and removes files staged without one."""
    fs, path = _file_system(spark, folder)
    manifest = path(f"{folder}/_reshard-manifest")
    if fs.exists(manifest):
        plan = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(manifest), "UTF-8"))
        for src, dst in plan["renames"]:
            if fs.exists(path(src)):
                fs.mkdirs(path(dst).getParent())
                fs.rename(path(src), path(dst))
        for old in plan["deletions"]:
            fs.delete(path(old), False)
        fs.delete(manifest, False)
    for status in fs.listStatus(path(folder)):
        if status.getPath().getName().startswith("_reshard-"):
            fs.delete(status.getPath(), True)


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shard_documents(spark: SparkSession, docs: DataFrame, old: int = OLD_SHARDS, new: int = NEW_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) and old_shard of each row.

    The old shards go by a hash of the text, so a text that many rows share makes its shard large.
    The longest texts of a shard stay, and cuts fall among its short ones; equal texts, which their sizes and
    hashes stand for, lie side by side. Null text has no bytes and counts as empty. Repeated rows have a slot each; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", F.pmod("text_crc32", F.lit(old)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    rows = Scratch(spark, "shards").save(rows.withColumn("same", F.struct("size", "text_crc32")), "sized")
    order = [F.col("size").desc(), F.col("text_crc32"), F.col("doc_id"), F.col("row")]
    found = assign(spark, rows, order, new, group="same")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("new_shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("shard").alias("old_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: With costs of 0 for bytes that stay and 1 for others, surpluses in order fill free room in order.
SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS s FROM documents),
c AS (SELECT doc_id, size, {crc32_sql("s")} AS crc FROM d, t),
o AS (SELECT row_number() OVER () AS id, doc_id, size, crc, crc % {OLD_SHARDS} AS old FROM c),
l AS (SELECT *, row_number() OVER w - 1 AS rank, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM o WINDOW w AS (PARTITION BY old ORDER BY size DESC, crc, doc_id NULLS FIRST, id)),
n AS (SELECT sum(size) AS total FROM o),
r AS (SELECT j, total // {NEW_SHARDS} + CASE WHEN j < total % {NEW_SHARDS} THEN 1 ELSE 0 END AS room FROM n, range({NEW_SHARDS}) k(j)),
b AS (SELECT old, sum(size) AS bytes FROM o GROUP BY 1),
k AS (SELECT j, room, coalesce(bytes, 0) AS bytes, least(room, coalesce(bytes, 0)) AS stay FROM r LEFT JOIN b ON old = j),
u AS (SELECT j AS i, stay, bytes - stay AS more, sum(bytes - stay) OVER (ORDER BY j) AS upto FROM k),
v AS (SELECT j, room - stay AS free, sum(room - stay) OVER (ORDER BY j) AS upto FROM k),
f AS (SELECT i, j, least(u.upto, v.upto) - greatest(u.upto - more, v.upto - free) AS bytes FROM u, v WHERE least(u.upto, v.upto) > greatest(u.upto - more, v.upto - free) UNION ALL SELECT i, i, stay FROM u WHERE stay > 0),
e AS (SELECT i, j, row_number() OVER w AS k, sum(bytes) OVER w AS high, sum(bytes) OVER (PARTITION BY i) AS whole FROM f WINDOW w AS (PARTITION BY i ORDER BY i <> j, j)),
g AS (SELECT old, size, crc, min(pos) AS low, max(pos + size) AS high FROM l GROUP BY 1, 2, 3),
m AS (SELECT e.i, e.j, e.k, CASE WHEN e.high < whole AND g.high - g.low <= (SELECT max(room) FROM r) // {WHOLE_SHARE} THEN CASE WHEN e.high - g.low <= g.high - e.high THEN g.low ELSE g.high END ELSE e.high END AS high
  FROM e LEFT JOIN g ON g.old = e.i AND g.low <= e.high AND e.high < g.high),
h AS (SELECT i, j, coalesce(max(high) OVER (PARTITION BY i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, max(high) OVER (PARTITION BY i ORDER BY k) AS high FROM m),
p AS (SELECT l.*, j FROM l JOIN h ON h.i = l.old AND 2 * h.low <= 2 * l.pos + l.size AND 2 * l.pos + l.size < 2 * h.high)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, j::INT AS shard, row_number() OVER (PARTITION BY j ORDER BY old, rank) - 1 AS slot, NULL::INT AS grown_shard, old::INT AS old_shard FROM p
"""
