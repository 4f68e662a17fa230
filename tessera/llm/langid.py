"""Language identification by hierarchical discrimination.

Languages whose mean character trigrams are alike form families. A document is first given a
family (one linear support vector machine a family against the rest), then a language in it by
one-versus-one linear support vector machines over the family's pairs. Features are hashed
byte trigrams of the lower-cased text, as shares of the text's trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table

#: Documents that the machines are fitted on, shared evenly by the languages, and the least share of a language.
FIT_ROWS, FIT_EACH = 1024, 8
#: Buckets of hashed trigrams.
BUCKETS = 8192
#: Strength of the regularisation, and steps of the fit.
RIDGE, STEPS = 1e-4, 200
#: Bytes of a text that are hashed at once.
WINDOW = 1 << 20
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_KEPT = np.where([chr(b).isalpha() or b >= 128 for b in range(256)], np.arange(256), 32).astype(np.uint8)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of a text, window by window; everything but letters is a space."""
    data = f" {text.lower()} ".encode()
    for at in range(0, len(data) - 2, WINDOW):
        b = _KEPT[np.frombuffer(data, np.uint8, min(WINDOW + 2, len(data) - at), at)].astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        yield ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _spread(key: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) to learn from, the first documents by hash: FIT_ROWS evenly from the languages, but FIT_EACH of each.

    A document is an id with a text, so neither repeated rows nor repeated ids add to the bound.
    """
    usable = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("size")).collect()
    if not sizes:
        return usable.limit(0).select("lang", "text")
    each = max(FIT_EACH, FIT_ROWS // len(sizes))
    # A share of the documents a little above the need, then the first of them: a language's never meet in one task.
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, (2.0 * each + 50) / max(r["size"], 1))))])
    some = usable.where(_spread(F.col("key")) < share[F.col("lang")]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(_spread(F.col("key")), "key")
    return some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("lang", "text")


@dataclass
class Model:
    families: list[list[str]]
    weights: np.ndarray  # BUCKETS x machines: the families', then each family's pairs'
    bias: np.ndarray
    pairs: list[list[tuple[int, int]]]

    def decide(self, sums: np.ndarray, n: int) -> tuple[str, float]:
        """Language and confidence from the summed weights of a text's n trigrams."""
        margin = sums / max(n, 1) + self.bias
        chance = 1 / (1 + np.exp(-np.clip(4 * margin, -40, 40)))
        count = len(self.families)
        f = int(np.argmax(margin[:count])) if count > 1 else 0
        sure = float(chance[f]) if count > 1 else 1.0
        names = self.families[f]
        if len(names) == 1:
            return names[0], sure
        at = count + sum(len(p) for p in self.pairs[:f])
        votes, belief = np.zeros(len(names)), np.zeros(len(names))
        for k, (i, j) in enumerate(self.pairs[f]):
            c = chance[at + k]
            votes[i if c >= 0.5 else j] += 1
            belief[i] += c
            belief[j] += 1 - c
        won = max(range(len(names)), key=lambda i: (votes[i], belief[i], names[i]))
        return names[won], sure * float(belief[won]) / (len(names) - 1)


def families(names: list[str], means: np.ndarray) -> list[list[int]]:
    """Languages by likeness of their mean features: average linkage, to about the root of their number."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    like = (unit @ unit.T).astype(np.float64)  # summed over the members of two groups
    size = np.ones(len(names))
    groups = [[i] for i in range(len(names))]
    while len(groups) > max(1, round(len(names) ** 0.5)):
        mean = np.where(np.tri(len(groups), dtype=bool), -np.inf, like / np.outer(size, size))
        a, b = (int(i) for i in np.unravel_index(int(mean.argmax()), mean.shape))
        like[a] += like[b]
        like[:, a] += like[:, b]
        size[a] += size[b]
        like, size = np.delete(np.delete(like, b, 0), b, 1), np.delete(size, b)
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, both classes of equal weight; accelerated gradient."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    w0, b0 = w.copy(), b
    step = 1 / (2 * float((share * ((x * x).sum(1) + 1)).sum()) + RIDGE)
    for k in range(STEPS):
        m = k / (k + 3)
        v, c = w + m * (w - w0), b + m * (b - b0)
        g = 2 * share * y * np.maximum(0, 1 - y * (x @ v + c))
        w0, b0 = w, b
        w, b = v + step * (g @ x - RIDGE * v), c + step * float(g.sum())
    return w, b


def fit(docs: DataFrame) -> Model | None:
    """The model from ``sample(docs)``; None without a usable document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                c = np.zeros(BUCKETS, np.int64)
                for t in trigrams(text):
                    c += np.bincount(t, minlength=BUCKETS)
                at = np.flatnonzero(c)
                rows.append((at.astype(np.int32).tobytes(), (c[at] / c.sum()).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                ["lang", "at", "share"],
            )

    rows = sorted(tuple(r) for r in sample(docs).mapInArrow(run, "lang string, at binary, share binary").collect())
    if not rows:
        return None
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, (_, at, share) in enumerate(rows):
        x[k, np.frombuffer(at, np.int32)] = np.frombuffer(share, np.float32)
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x *= scale
    names = sorted({r[0] for r in rows})
    label = np.array([names.index(r[0]) for r in rows])
    groups = families(names, np.stack([x[label == i].mean(0) for i in range(len(names))]))
    group_of = {i: g for g, members in enumerate(groups) for i in members}
    group = np.array([group_of[i] for i in label])
    machines = [_machine(x, np.where(group == g, 1, -1).astype(np.float32)) for g in range(len(groups))]
    pairs = [list(combinations(range(len(members)), 2)) for members in groups]
    for members, own in zip(groups, pairs, strict=True):
        for i, j in own:
            use = (label == members[i]) | (label == members[j])
            machines.append(_machine(x[use], np.where(label[use] == members[i], 1, -1).astype(np.float32)))
    weights = np.stack([w for w, _ in machines], 1) * scale[:, None]
    return Model([[names[i] for i in members] for members in groups], weights, np.array([b for _, b in machines]), pairs)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each whole text.

    One row for each row. Null text and text without a letter are ``und`` with score 0.0, and so
    is all text if nothing could be learned. Only the text is used.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                if not text or own is None or not _LETTER.search(text):
                    found.append((UNDETERMINED, 0.0))
                    continue
                sums, n = np.zeros(len(own.bias)), 0
                for t in trigrams(text):
                    sums += own.weights[t].sum(0, dtype=np.float64)
                    n += len(t)
                found.append(own.decide(sums, n))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(spark, docs, fit(docs))
