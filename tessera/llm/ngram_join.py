"""N-gram Jaccard join: a grouped prefix join that returns the components of its links.

Texts are sets of hashed word shingles, ordered by rising frequency (a sketch's bound, then the
hash). Two sets that are as similar as asked share one of their first few shingles, so only
these prefixes are joined. Equal sets are one class, and classes with equal prefix and size one
group. Pairs of groups that meet in a shingle are filtered by size, by the shingle's place and by
their whole prefixes; only pairs of groups that pass are expanded to pairs of their classes,
which are verified on the whole sets.

Links are only needed up to connection, so pairs that earlier links already connect are not
verified: first each group is held against the most connected group it meets and each class
against its group's first, then one pair of any two components whose groups still meet, at last
every pair of classes of different components. No list of shingles, groups or partners is cut,
and a pair of classes is left out only if both are connected already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .shared import Scratch, join_folded, join_spread, read_table
from .shingles import frequency_sketch, shingle_set, word_hashes

#: Rows up to which a side that a count has measured is broadcast (16 bytes a row).
BROADCAST_ROWS = 200_000
#: Rounds at most in which one pair of any two components is tried before all that are left.
ROUNDS = 4
#: Groups of one shingle, and classes of one group, that are paired in one task.
PAIRED = 512


def _ceil_share(n: int | Column, num: int, den: int):
    """Smallest whole number that is at least n * num / den."""
    if isinstance(n, Column):
        return F.floor((n * num + (den - 1)) / den).cast("long")
    return (n * num + den - 1) // den


def _class_of(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _document() -> Column:
    """64 bits that stand for a document: its id and its text, since ids may repeat."""
    return F.xxhash64("doc_id", "text")


def signatures(spark: SparkSession, docs: DataFrame, width: int, num: int, den: int, bits: int | None = None) -> DataFrame:
    """doc_id, document (its id with its text), n (set size), class_id (hash of the set), alike (of prefix and size) and prefix."""
    counted = frequency_sketch(spark, docs, width, bits)
    sketch, mask = spark.sparkContext.broadcast(counted), np.uint64(len(counted) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            n, class_id, alike, prefixes, at = [], [], [], [], [0]
            for words in word_hashes(batch.column(2)):
                s = shingle_set(words, width)
                size = len(s)
                first = s
                if size:
                    order = np.lexsort((s, counts[(s & mask).astype(np.int64)]))
                    first = s[order[: size - _ceil_share(size, num, den) + 1]]
                n.append(size)
                class_id.append(_class_of(s))
                alike.append(hashlib.blake2b(first.tobytes(), digest_size=16, person=b"%d" % size).digest())
                prefixes.append(first)
                at.append(at[-1] + len(first))
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(class_id, pa.int64()), pa.array(alike), lists],
                ["doc_id", "document", "n", "class_id", "alike", "prefix"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", _document().alias("document"), "text").mapInArrow(
        run, f"doc_id {kind}, document bigint, n bigint, class_id bigint, alike binary, prefix array<bigint>"
    )


def _sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """class_id and the whole set of the classes (class_id, lead_id) named, from texts of the ids that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w, width) for w in word_hashes(batch.column(1))]
            keep = [_class_of(s) == c for s, c in zip(sets, batch.column(0).to_pylist(), strict=True)]
            own = [s for s, k in zip(sets, keep, strict=True) if k]
            at = np.cumsum([0, *map(len, own)])
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), lists], ["class_id", "items"])

    found = docs.select("doc_id", "text").join(classes, F.col("doc_id") == F.col("lead_id")).select("class_id", "text")
    return found.mapInArrow(run, "class_id bigint, items array<bigint>")


class _Join:
    def __init__(self, spark: SparkSession, docs: DataFrame, width: int, num: int, den: int, bits: int | None):
        self.spark, self.docs, self.width, self.num, self.den = spark, docs, width, num, den
        self.scratch = Scratch(spark, "ngram-join")
        save = self.scratch.save
        self.texts = save(signatures(spark, docs, width, num, den, bits), "texts")
        best = F.min(F.struct("doc_id", "n", "alike", "prefix")).alias("best")
        classes = self.texts.where("n > 0 AND doc_id IS NOT NULL").groupBy("class_id").agg(best)
        classes = save(classes.select("class_id", F.col("best.doc_id").alias("lead_id"), "best.n", "best.alike", "best.prefix"), "sets")
        groups = classes.groupBy("alike").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("size"))
        found = join_folded(classes, save(groups, "groups"), "alike", "size", classes.count()).drop("alike")
        leads = F.col("class_id") == F.col("group_id")
        self.classes = save(found.withColumn("prefix", F.when(leads, F.col("prefix"))), "classes")
        self.scratch.drop("sets", "groups")

    def alike(self, a: Column, b: Column, an: Column, bn: Column) -> Column:
        """Whether groups that meet at places a and b of their prefixes can be similar enough."""
        need = _ceil_share(an + bn, self.num, self.num + self.den)
        reach = 1 + F.least(an - a - 1, bn - b - 1)
        return (self.den * F.least(an, bn) >= self.num * F.greatest(an, bn)) & (reach >= need)

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(token, group_id, n, size, place) of prefix shingles that two groups or more share, and their groups by token.

        The first one of a group of several classes stays too: there its own classes meet each
        other, which ``alike`` lets pass at place 0 but not always at a later one.
        """
        of_group = self.classes.where("prefix IS NOT NULL").select("group_id", "n", "size", F.posexplode("prefix").alias("place", "token"))
        own = F.count_if((F.col("size") > 1) & (F.col("place") == 0))
        tokens = of_group.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), own.alias("own"))
        tokens = self.scratch.save(tokens.where("groups > 1 OR own > 0").select("token", "groups"), "tokens")
        total = tokens.agg(F.sum("groups")).first()[0] or 0
        rows = join_folded(of_group, tokens, "token", "groups", total)
        return self.scratch.save(rows.where("groups > 1 OR place = 0"), "postings"), tokens

    def plausible(self, pairs: DataFrame, name: str) -> DataFrame:
        """The distinct pairs (a, b) of groups that share enough of their prefixes.

        Whichever prefix ends first in the common order, what lies beyond it in its set bounds
        the rest of the intersection. A group paired with itself shares all.
        """
        pairs = self.scratch.save(pairs.distinct(), f"{name}-groups")
        lead = self.classes.where("prefix IS NOT NULL").select("group_id", "n", "prefix")
        count = pairs.count()
        if not count:
            return pairs
        few = count <= BROADCAST_ROWS
        needed = pairs.select(F.col("a").alias("group_id")).union(pairs.select("b")).distinct()
        lead = self.scratch.save(lead.join(F.broadcast(needed) if few else needed, "group_id"), f"{name}-prefixes")
        common = F.size(F.array_intersect("xa", "xb"))
        rest = F.greatest(F.col("na") - F.size("xa"), F.col("nb") - F.size("xb"))
        need = _ceil_share(F.col("na") + F.col("nb"), self.num, self.num + self.den)
        met = self._beside(pairs, lead.select(F.col("group_id").alias("id"), "n", F.col("prefix").alias("x")), few)
        kept = self.scratch.save(met.where((F.col("a") == F.col("b")) | (common + rest >= need)).select("a", "b"), f"{name}-pairs")
        self.scratch.drop(f"{name}-groups", f"{name}-prefixes")
        return kept

    def _beside(self, pairs: DataFrame, wide: DataFrame, few: bool) -> DataFrame:
        """pairs (a, b) with the columns of ``wide`` (id, n, x) of both; no id gathers all its pairs in one task."""
        left, right = [wide.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("x").alias(f"x{c}")) for c in "ab"]
        rows = left.join(F.broadcast(pairs), "a") if few else join_spread(pairs, left, "a", "b", pairs)
        return join_spread(rows, right, "b", "a", pairs)

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The distinct pairs (a, b) of classes that are links, by their whole sets."""
        pairs = self.scratch.save(pairs.distinct(), f"{name}-asked")
        count = pairs.count()
        if not count:
            return pairs
        few = count <= BROADCAST_ROWS
        needed = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct()
        of = self.classes.select("class_id", "lead_id")
        needed = self.scratch.save(of.join(F.broadcast(needed) if few else needed, "class_id"), f"{name}-needed")
        sets = self.scratch.save(_sets(self.docs, F.broadcast(needed) if few else needed, self.width), f"{name}-sets")
        sets = sets.groupBy("class_id").agg(F.first("items").alias("items"))
        met = self._beside(pairs, sets.select(F.col("class_id").alias("id"), F.size("items").alias("n"), F.col("items").alias("x")), few)
        both = F.size(F.array_intersect("xa", "xb"))
        union = F.col("na") + F.col("nb") - both
        links = self.scratch.save(met.where(self.den * both >= self.num * union).select("a", "b"), f"{name}-links")
        self.scratch.drop(f"{name}-sets", f"{name}-needed", f"{name}-asked", f"{name}-pairs")
        return links

    def run(self) -> DataFrame:
        """(node, component) of the classes that have a link to another."""
        save = self.scratch.save
        postings, tokens = self.postings()
        degree = postings.groupBy("group_id").agg(F.count(F.lit(1)).alias("degree"))
        ranked = postings.join(degree, "group_id")
        as_hub = [F.col(c).alias(f"hub_{c}") for c in ("degree", "group_id", "n", "place")]
        hub = ranked.groupBy("token").agg(F.max(F.struct(*as_hub)).alias("h"), F.count(F.lit(1)).alias("hub_groups"))
        hub = save(hub.select("token", "hub_groups", "h.*"), "hubs")
        total = hub.agg(F.sum("hub_groups")).first()[0] or 0
        met = join_folded(postings, hub, "token", "hub_groups", total).where("group_id <> hub_group_id")
        met = met.where(self.alike(F.col("place"), F.col("hub_place"), F.col("n"), F.col("hub_n")))
        met = met.groupBy("group_id", "hub_group_id").agg(F.count(F.lit(1)).alias("shared"))
        first = met.groupBy("group_id").agg(F.max(F.struct("shared", "hub_group_id")).alias("h"))
        first = self.plausible(first.select(F.col("group_id").alias("a"), F.col("h.hub_group_id").alias("b")), "first")
        within = self.classes.where("class_id <> group_id").select(F.col("class_id").alias("a"), F.col("group_id").alias("b"))
        links = self.verify(first.unionByName(within), "first")
        labels = connected(self.spark, links, self.scratch, "first")
        name, k = "near-0", 0
        while True:
            pairs, members = self.apart(postings, tokens, labels, name)
            more = self.verify(self.expanded(pairs, members, name), name) if name != "rest" or pairs.head(1) else pairs
            found = bool(more.head(1))
            if found:
                links = save(links.unionByName(more), f"{name}-all")
                labels = connected(self.spark, links, self.scratch, name)
            self.scratch.drop(f"{name}-members")
            if name == "rest":
                break
            # Pairs between components are tried one at a time while that joins some, then all that are left.
            k += 1
            name = f"near-{k}" if found and k < ROUNDS else "rest"
        self.scratch.drop("postings", "tokens", "hubs", "first-links", "rest-links")
        return labels

    def apart(self, postings: DataFrame, tokens: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Plausible pairs (a, b) of groups that are not yet in one component, and (group_id, class_id, size, component)."""
        named = labels.select(F.col("node").alias("class_id"), "component")
        members = self.classes.select("group_id", "class_id", "size").join(named, "class_id", "left")
        members = self.scratch.save(members.withColumn("component", F.coalesce("component", "class_id")), f"{name}-members")
        spans = members.groupBy("group_id").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        rows = self.scratch.save(postings.join(spans, "group_id"), f"{name}-rows")
        several = rows.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("token")
        several = several.join(tokens, "token").withColumn("blocks", F.ceil(F.col("groups") / PAIRED).cast("int"))
        several = self.scratch.save(several, f"{name}-tokens")
        total = several.agg(F.sum("groups")).first()[0] or 0
        if not total:
            return several.select(F.lit(0).alias("a"), F.lit(0).alias("b")), members
        rows = join_folded(rows.drop("groups"), several, "token", "groups", total)
        # A shingle's groups are dealt into blocks, and each pair of blocks is one key.
        block, every = F.pmod(F.xxhash64("group_id"), "blocks").cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
        x = rows.withColumn("i", block).withColumn("j", F.explode(every)).alias("x")
        y = rows.withColumn("j", block).withColumn("i", F.explode(every)).alias("y")
        one = (F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo"))
        meet = x.join(
            y,
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.i") == F.col("y.i"))
            & (F.col("x.j") == F.col("y.j"))
            & (F.col("x.group_id") <= F.col("y.group_id"))
            & ~one
            & self.alike(F.col("x.place"), F.col("y.place"), F.col("x.n"), F.col("y.n")),
        )
        met = meet.select(F.col("x.group_id").alias("a"), F.col("y.group_id").alias("b"), F.col("x.lo").alias("ca"), F.col("y.lo").alias("cb"))
        if name != "rest":
            # One pair of groups of any two components, the one that shares most; those within one come last.
            met = met.where("ca <> cb").groupBy("a", "b", "ca", "cb").agg(F.count(F.lit(1)).alias("shared"))
            best = F.max(F.struct("shared", "a", "b")).alias("p")
            met = met.groupBy(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")).agg(best).select("p.a", "p.b")
        pairs = self.plausible(met.select("a", "b"), name)
        self.scratch.drop(f"{name}-rows", f"{name}-tokens")
        return pairs, members

    def expanded(self, pairs: DataFrame, members: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) of classes of different components whose groups are paired: one of any two components, at last all."""
        if name != "rest":
            members = members.groupBy("group_id", "component").agg(F.min("class_id").alias("class_id"), F.first("size").alias("size"))
        blocks = F.ceil(F.col("size") / PAIRED).cast("int")
        side = members.withColumn("block", F.pmod(F.xxhash64("class_id"), blocks).cast("int"))
        large = self.classes.where(F.col("size") > PAIRED).select("group_id", "size").distinct()
        rows = pairs
        for end, c in (("a", "x"), ("b", "y")):
            # Pairs of a large group are copied once a block, so its classes meet them in as many tasks. There are few
            # such groups, at most one for PAIRED classes.
            of = large.select(F.col("group_id").alias(end), blocks.alias("blocks"))
            rows = rows.join(of, end, "left").withColumn(f"{c}_block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
            own = side.select(F.col("group_id").alias(end), F.col("block").alias(f"{c}_block"), F.col("class_id").alias(c), F.col("component").alias(f"{c}_of"))
            rows = rows.join(own, [end, f"{c}_block"])
        rows = rows.where("x_of <> y_of AND (a <> b OR x < y)")
        if name != "rest":
            one = F.min(F.struct("x", "y")).alias("p")
            rows = rows.groupBy(F.least("x_of", "y_of").alias("lo"), F.greatest("x_of", "y_of").alias("hi")).agg(one).select("p.x", "p.y")
        return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _labelled(spark: SparkSession, docs: DataFrame, width: int, num: int, den: int, bits: int | None = None) -> DataFrame:
    """``components`` with the column document."""
    join = _Join(spark, docs, width, num, den, bits)
    save = join.scratch.save
    labels = join.run().select(F.col("node").alias("class_id"), "component")
    of_class = join.classes.select("class_id", "lead_id").join(labels, "class_id", "left")
    of_class = save(of_class.withColumn("component", F.coalesce("component", "class_id")), "components")
    # Inside, the smallest class names a component; outside, its smallest doc_id does.
    names = of_class.groupBy("component").agg(F.min("lead_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = join_folded(of_class, save(names, "names"), "component", "classes", of_class.count())
    linked = join.texts.where("n > 0 AND doc_id IS NOT NULL")
    copies = linked.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    named = save(named.select("class_id", "component_id").join(copies, "class_id"), "of-class")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "document"]
    found = join_folded(linked, named, "class_id", "copies", linked.count()).select(*columns)
    alone = join.texts.where("NOT (n > 0 AND doc_id IS NOT NULL)").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(alone.select(*columns))


def components(spark: SparkSession, docs: DataFrame, width: int, num: int, den: int, bits: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``.

    Texts link when den * |intersection| >= num * |union| of their sets of ``width``-word
    shingles; the component's id is its smallest doc_id. A text without words has the empty set
    and links with nothing; one of fewer than ``width`` words is one shingle. A row without a
    doc_id links with nothing and has no component_id. Repeated rows are in one component; rows
    of one id with different texts are documents of their own. Other columns are ignored.
    """
    return _labelled(spark, docs, width, num, den, bits).drop("document")


def one_of_each(spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it. All columns stay.

    Rows without words or without a doc_id stay, and so do repeated rows of the document that
    stays; rows of one id go by their own texts.
    """
    found = _labelled(spark, docs, width, num, den)
    gone = found.where("component_id <> doc_id").select(F.col("document").alias("_document")).distinct()
    marked = docs.select(F.struct("*").alias("_row"), _document().alias("_document"))
    return marked.join(gone, "_document", "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, read_table(spark, sf_dir, "documents"), width=3, num=90, den=100)
