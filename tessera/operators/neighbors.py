"""Near duplicates by difference hash: blocked Hamming join, components and thinning."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairing import placed
from .written import Written, join_folded

HASH_BITS = 64
#: Probes of one hash at most: 428 for 10 bits of 64, 1006 for 16 of 63.
MOST_PROBES = 1024


def difference_hash(values: Column, row: int | None = None) -> Column:
    """Bits of whether a value exceeds the next, most significant first; ``row`` values make a row.

    63 bits at most stay a positive BIGINT; a 9 x 8 image (row=9) fills all 64.
    """
    steps = F.sequence(F.lit(0), F.size(values) - 2)
    if row:
        steps = F.filter(steps, lambda i: i % row != row - 1)
    bit = lambda i: (F.get(values, i) > F.get(values, i + 1)).cast("long")
    return F.aggregate(steps, F.lit(0).cast("long"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(bit(i)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(most: int, bits: int = HASH_BITS, probes: int = MOST_PROBES) -> list[tuple[int, int, int]]:
    """(shift, width, flips) of disjoint runs of bits: hashes within ``most`` differ in at most ``flips`` bits of one of them.

    If every run differed in more, the sum over the runs would be above ``most``. Wide runs make
    few candidates and many probes, so they are as wide as the number of probes a hash allows.
    """
    for count in range(1, most + 2):
        edges = [round(k * bits / count) for k in range(count + 1)]
        each, more = divmod(most - count + 1, count)
        found = [(a, b - a, each + (k < more)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        if sum(comb(w, f) for _, w, flips in found for f in range(flips + 1)) <= probes:
            break
    return found


def _flipped(width: int, flips: int) -> list[int]:
    """Masks of at most ``flips`` of ``width`` bits."""
    return [sum(1 << i for i in at) for f in range(flips + 1) for at in combinations(range(width), f)]


def _leads(hashes: DataFrame, written: Written) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, hash) that have a hash, the first id and number of each hash, and the number of rows."""
    rows = hashes.where("hash IS NOT NULL").select("id", "hash")
    lead = written.save(rows.groupBy("hash").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("copies")), "leads")
    return rows, lead, lead.agg(F.sum("copies")).first()[0] or 0


def near_leads(lead: DataFrame, most: int, bits: int = HASH_BITS) -> DataFrame:
    """(a, b, distance) with a < b of all (id, hash) of different hashes within ``most`` bits.

    Each hash is indexed by its runs of bits and probes them with few bits flipped.
    """
    runs = bands(most, bits)
    run = lambda c, s, w: F.shiftrightunsigned(c, s).bitwiseAND(F.lit((1 << w) - 1)) if w < HASH_BITS else c
    keyed = lead.select("id", "hash", F.posexplode(F.array(*[run(F.col("hash"), s, w) for s, w, _ in runs])).alias("band", "value"))
    masks = F.get(F.array(*[F.lit(_flipped(w, f)) for _, w, f in runs]), F.col("band"))
    probes = keyed.select("id", "hash", "band", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    x, y = probes.alias("x"), keyed.alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.id") < F.col("y.id"))
    distance = hamming(F.col("x.hash"), F.col("y.hash")).cast("int")
    # A pair is found in the first run that is near enough, so no distinct has to follow.
    differ = F.col("x.hash").bitwiseXOR(F.col("y.hash"))
    earlier = F.lit(True)
    for k, (s, w, flips) in enumerate(runs):
        earlier = earlier & ((F.lit(k) >= F.col("x.band")) | (F.bit_count(run(differ, s, w)) > flips))
    found = x.join(y, same & (distance <= most) & earlier)
    return found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), distance.alias("distance"))


def near_pairs(hashes: DataFrame, most: int, bits: int = HASH_BITS) -> DataFrame:
    """(a, b, distance) with a < b: pairs of near hashes, each by its first id, and each other id with its hash's first at distance 0.

    So all links between different hashes are there, and copies do not multiply them; null hashes have none. The
    copies of a hash that many rows have meet a broadcast of its first id.
    """
    rows, lead, total = _leads(hashes, Written(hashes.sparkSession, "near"))
    copies = join_folded(rows, lead, "hash", "copies", total).where("id <> lead")
    chained = copies.select(F.col("lead").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return near_leads(lead.select(F.col("lead").alias("id"), "hash"), most, bits).unionByName(chained)


def similar(hashes: DataFrame, most: int, bits: int = HASH_BITS) -> DataFrame:
    """(id, component) of every (id, hash) that another one is near to, through others too: the smallest id of its group.

    Only first ids of hashes go through ``components``; copies follow theirs.
    """
    written = Written(hashes.sparkSession, "similar")
    rows, lead, total = _leads(hashes, written)
    linked = components(near_leads(lead.select(F.col("lead").alias("id"), "hash"), most, bits))
    named = lead.join(linked.withColumnRenamed("id", "lead"), "lead", "left")
    named = named.where("component IS NOT NULL OR copies > 1").select("hash", "copies", F.coalesce("component", "lead").alias("component"))
    return join_folded(rows, written.save(named, "named"), "hash", "copies", total).select("id", "component")


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of every node in pairs (a, b): the smallest id it is connected with.

    Labels fall along edges and then jump to their label's label, so rounds grow with the
    logarithm of the longest chain. Each round is a written table that all executors share. A node of many
    edges, and a label that many nodes have, are broadcast to where these are.
    """
    spark = pairs.sparkSession
    written = Written(spark, "components")
    save, drop = written.save, written.drop
    edges = save(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    total = edges.count()
    found = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("component"), F.count(F.lit(1)).alias("edges"))
    labels = save(found.withColumnRenamed("u", "id"), "labels-0")
    k = 0
    while True:
        k += 1
        heads = labels.select(F.col("id").alias("v"), "component", F.col("edges").alias("size"))
        offered = join_folded(edges, heads, "v", "size", total).groupBy("u").agg(F.min("component").alias("offer"))
        lower = labels.join(offered, labels["id"] == offered["u"], "left").select("id", F.least("component", "offer").alias("component"), "edges")
        lower = save(lower, f"fall-{k}")
        sizes = lower.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        heads = sizes.join(lower.select(F.col("id").alias("component"), F.col("component").alias("next")), "component")
        jump = join_folded(lower, save(heads, f"heads-{k}"), "component", "size", total)
        after = save(jump.select("id", F.least("component", "next").alias("component"), "edges"), f"labels-{k}")
        moved = after.alias("x").join(labels.alias("y"), "id").where("x.component <> y.component").limit(1).count()
        drop(f"labels-{k - 1}", f"fall-{k}", f"heads-{k}")
        labels = after
        if not moved:
            drop("edges")
            return labels.select("id", "component")


def thin(grouped: DataFrame, keep: float = 0.3, least: int = 2, seed: str = "0") -> DataFrame:
    """Adds group_size, keep_count and keep to (id, component): a seeded sample of each group stays.

    Kept are the share rounded half to even, ``least`` at least and the group's size at most,
    chosen in the order of md5(seed || id). The order is one range sort of all rows, so a group of any
    size is spread over tasks.
    """
    order = [F.col("component"), F.col("_order"), F.col("id")]
    rows = placed(grouped.withColumn("_order", F.md5(F.concat(F.lit(seed), F.col("id").cast("string")))), order)
    rows = Written(grouped.sparkSession, "thin").save(rows, "placed")
    groups = rows.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"), F.min("place").alias("_first"))
    rows = join_folded(rows, groups, "component", "group_size", rows.count())
    count = F.least(F.greatest(F.lit(least), F.bround(F.col("group_size") * keep).cast("int")), F.col("group_size")).cast("int")
    return rows.withColumn("keep_count", count).withColumn("keep", F.col("place") - F.col("_first") < F.col("keep_count")).select(*grouped.columns, "group_size", "keep_count", "keep")
