"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be copied target / source size times. The whole part is
certain; the fractional parts are rounded in pairs: words of expected mass move at random
between two documents until one of them is integral. The moves keep each document's
expected copies and the source's sum of words. A source's longest documents come first, each
against the pool of all shorter ones, which have one fraction in common. The others are dealt
into chunks by a hash of the id; a chunk leaves at most one fractional document, and these
residuals meet in ever fewer chunks (a reduction tree of FAN_IN branches) until one a source
is left, which is rounded alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, join_folded, read_table, word_count

#: Documents that one task rounds at once, and branches of the reduction tree.
FAN_IN = 4096
#: A document of more than its source's words by this is long; a source has no more long ones than this.
LONG_SHARE = 256
#: A document is copied, and so a source can grow, this many times at most.
MOST_COPIES = 3


def pivotal(sizes: np.ndarray, fractions: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds ``fractions`` in pairs; the positions left fractional are at most one.

    Keeps sum(sizes * fractions) and each expected value. Returns the new fractions (0.0 or
    1.0 but for the residual) and the residual's position, -1 if there is none.
    """
    p, open_at = fractions.copy(), -1
    for j in range(len(p)):
        if p[j] <= 0.0 or p[j] >= 1.0:
            continue
        if open_at < 0:
            open_at = j
            continue
        i, a, b = open_at, sizes[open_at], sizes[j]
        give, take = min((1 - p[i]) * a, p[j] * b), min(p[i] * a, (1 - p[j]) * b)
        if draws[j] * (give + take) < take:
            full, p[i], p[j] = (1 - p[i]) * a <= p[j] * b, p[i] + give / a, p[j] - give / b
            i_done, j_done, to_i, to_j = full, not full or p[j] * b < 1e-9, 1.0, 0.0
        else:
            empty, p[i], p[j] = p[i] * a <= (1 - p[j]) * b, p[i] - take / a, p[j] + take / b
            i_done, j_done, to_i, to_j = empty, not empty or (1 - p[j]) * b < 1e-9, 0.0, 1.0
        if i_done:
            p[i] = to_i
        if j_done:
            p[j] = to_j
        open_at = -1 if i_done and j_done else j if i_done else i
    return p, open_at


def _round_chunk(level: int, seed: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Long texts first: the short ones after them even out what is left of them.
        rows = rows.sort_values(["size", "doc_id", "order"], ascending=False, kind="stable", ignore_index=True)
        name = hashlib.sha256(f"{seed}|{level}|{key[0]}|{key[1]}".encode()).digest()[:16]
        draws = np.random.Generator(np.random.Philox(key=int.from_bytes(name, "little"))).random(len(rows))
        p, left = pivotal(rows["size"].to_numpy(float), rows["fraction"].to_numpy(float), draws)
        if last and left >= 0:
            p[left], left = float(draws[left] < p[left]), -1
        rows["fraction"] = p
        rows["open"] = False
        if left >= 0:
            rows.loc[left, "open"] = True
        return rows

    return run


def _settle_long(seed: int):
    """Rounds a source's long documents, longest first, against the pool of all that come after them.

    A document is taken with the probability of its fraction, and the pool gives or gets the
    difference. Where the pool could even out only one outcome, it is that one, and where none,
    the one that misses the source's words by less: the sum goes before that document's chance.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "order"], ascending=False, kind="stable", ignore_index=True)
        name = hashlib.sha256(f"{seed}|long|{key[0]}".encode()).digest()[:16]
        draws = np.random.Generator(np.random.Philox(key=int.from_bytes(name, "little"))).random(len(rows))
        rest, p, settled = float(rows["source_size"].iloc[0]), float(rows["fraction"].iloc[0]), []
        for a, draw in zip(rows["size"].to_numpy(float), draws, strict=True):
            rest -= a
            words = p * (a + rest)
            take, leave = a <= words, words <= rest  # whether the pool evens it out
            if rest <= 0 or p in (0.0, 1.0) or take and leave:
                q = draw < p
            else:
                q = take if take or leave else a - words < words - rest
            if rest > 0:
                p = min(max((words - q * a) / rest, 0.0), 1.0)
                p = 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p
            settled.append(float(q))
        rows["fraction"], rows["pool"] = settled, p
        return rows

    return run


def source_targets(spark: SparkSession, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Words that each source shall give, from (source, size) of documents: source, source_size, source_docs, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. The targets share all words by
    weight but stop at MOST_COPIES times the source's size; the excess goes to the others by
    weight until none is above. The sources are numbered in a range sort, written, and each
    round of sharing the excess is one sum over them.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs")
    )
    parts, by_name = int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(parts, by_name).sortWithinPartitions(by_name)
    ranged = ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    ranged = scratch.save(ranged, "sources")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"))
    before = before.select("part", "first", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    # Ids rise by one within a partition.
    place = F.col("id") - F.col("first") + F.col("before")
    weighed = ranged.join(F.broadcast(before), "part").select(
        "source", "source_size", "source_docs", (place % 3 + 1).cast("double").alias("weight"), (F.col("source_size") * float(MOST_COPIES)).alias("cap")
    )
    weighed = scratch.save(weighed, "weights")
    level, seen = 0.0, None
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        now = weighed.agg(
            F.sum("source_size").alias("words"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if not now["words"] or not now["open"] or (now["full"], now["open"]) == seen:
            break
        level, seen = (now["words"] - now["full"]) / now["open"], (now["full"], now["open"])
    return weighed.select("source", "source_size", "source_docs", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Copies of each document in the mix.

    One row for each row of ``docs``: doc_id, source, size (words; null text: 0), source_size,
    target, copies, taken (copies * size). Reruns on the same rows agree, however they are
    partitioned: the draws depend on ids and the seed alone. Repeated rows are rounded one by
    one; a text without words takes 0 words; an empty table gives no rows.
    """
    scratch = Scratch(spark, "mix")
    source = F.col("source").cast("string")
    sized = scratch.save(
        docs.select(
            F.col("doc_id"),
            source.alias("source"),
            F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit(""))).alias("key"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text")).alias("order"),
        ),
        "sized",
    )
    targets = source_targets(spark, sized, scratch)
    rate = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    whole = F.least(F.floor(rate + F.lit(1e-12)), F.lit(MOST_COPIES)).cast("long")
    key = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
    targets = targets.select(key.alias("key"), "source_size", "source_docs", "target", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("rest"))
    targets = scratch.save(targets, "targets")
    sums = targets.agg(F.max("source_docs"), F.sum("source_docs")).first()
    most, total = sums[0] or 0, sums[1] or 0
    columns = ["doc_id", "source", "key", "size", "order", "source_size", "target", "whole", "fraction"]

    def with_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
        found = join_folded(rows, targets, "key", "source_docs", total)
        fraction = F.when(F.col("size") > 0, F.col("rest")).otherwise(0.0)
        chunk = F.pmod("order", F.ceil(F.col("source_docs") / fan_in).cast("long"))
        return found.withColumn("fraction", fraction).withColumn("long", F.col("size") * LONG_SHARE > F.col("source_size")).select(*columns, "long", chunk.alias("chunk"))

    schema = ", ".join(f"{c} {t}" for c, t in with_rates(sized, targets).select(*columns).dtypes)
    long = with_rates(sized, targets).where("long").select(*columns)
    long = scratch.save(long.groupBy("key").applyInPandas(_settle_long(seed), f"{schema}, pool double"), "long")
    pools = long.groupBy("key").agg(F.min("pool").alias("pool"))
    targets = targets.join(pools, "key", "left").withColumn("rest", F.coalesce("pool", "rest")).drop("pool")
    open_rows = with_rates(sized, scratch.save(targets, "rates")).where("NOT long").select(*columns, "chunk")
    schema += ", chunk bigint, open boolean"
    done, level, chunks = [long.select(*columns)], 0, -(-most // fan_in)
    while True:
        last = chunks <= 1
        rounded = scratch.save(
            open_rows.groupBy("key", "chunk").applyInPandas(_round_chunk(level, seed, last), schema), f"level{level}"
        )
        done.append(rounded.where("NOT open").select(*columns))
        if last:
            break
        open_rows = rounded.where("open").drop("open").withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
        level, chunks = level + 1, -(-chunks // fan_in)
    scratch.drop("sized", "sources", "weights", "targets", "rates")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("fraction").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def draw(spark: SparkSession, docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows that it does not take go.

    All columns stay. Rows that share an id share their copies as evenly as whole numbers allow.
    """
    taken = mix(spark, docs, seed).groupBy("doc_id").agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")
    )
    key = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull()]
    left = docs.select(F.struct("*").alias("_row"), *[k.alias(n) for k, n in zip(key("doc_id"), ("_key", "_none"), strict=True)])
    right = taken.select("_copies", "_rows", *[k.alias(n) for k, n in zip(key("doc_id"), ("_key", "_none"), strict=True)])
    same_id = Window.partitionBy("_key", "_none").orderBy(F.lit(1))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_nth") <= F.col("_copies") % F.col("_rows")).cast("int")
    return (
        left.join(right.where("_copies > 0"), ["_key", "_none"])
        .withColumn("_nth", F.row_number().over(same_id))
        .withColumn("_take", F.explode(F.array_repeat(F.lit(0), share.cast("int"))))
        .select("_row.*")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )
