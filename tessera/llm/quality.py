"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio (DataFrame operations only).

Two multinomials over hashed n-grams are counted, one over all documents and one over
trusted ones. A document's score is the mean over its n-grams of the log ratio of trusted to
raw probability, so that length does not count. Below THRESHOLD it is rejected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, Scratch, read_table

#: Buckets of hashed n-grams as a power of two, the same for every table (1 MB of weights).
BITS = 18
#: Buckets whose weights are gathered in one row.
SLICE = 1 << 12
#: Trusted documents that the target multinomial is fitted on at most, the first by a hash of the id.
TRUSTED_ROWS = 16384
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.5
#: Added to each bucket's two counts, so that n-grams of a few documents weigh little.
SMOOTHING = 10.0
#: Letters and digits, or a run of other visible characters.
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
#: The base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _windows(words: str) -> Column:
    """Hashes of the windows of three hashed words."""
    h = F.col(words)
    return F.when(
        F.size(h) >= 3,
        F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null text has no words. Repeated windows are found by sorting their 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    a = docs.withColumn("_w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    a = a.withColumn("_lines", lines)
    a = a.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    kept = [c for c in a.columns if c != "_h"]
    a = a.select(*kept, _windows("_h").alias("_g"))
    a = a.select(*kept, F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.col("_g")).alias("_g"))
    a = a.select(*kept, F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("g"), i.alias("i")))).alias("_s"))
    s = F.col("_s")
    twice = F.filter(
        F.transform(
            s,
            lambda x, k: F.when(
                (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]), x["i"]
            ),
        ),
        lambda x: x.isNotNull(),
    )
    a = a.select(*kept, F.sort_array(twice).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x
    )
    a = a.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return a.withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )


def _hashes(text: Column) -> Column:
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    return F.transform(pieces, lambda x: F.xxhash64(x))


def _grams(h: Column, bits: int) -> Column:
    """Buckets of the unigrams and bigrams of hashed pieces."""
    buckets = F.lit(1 << bits)
    one = F.transform(h, lambda x: F.pmod(x, buckets).cast("int"))
    two = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), buckets).cast("int"))
    return F.concat(one, two)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """One row ``weights array<float>``: log of trusted by raw probability of each bucket.

    The raw counts cover all rows of ``docs``. Trusted are those labelled quality 1, TRUSTED_ROWS
    at most; their counts are scaled to the raw total before both are smoothed alike. Without
    any, all weights are 0.
    """
    trusted = (
        labels.where("quality = 1 AND doc_id IS NOT NULL")
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRUSTED_ROWS)
        .withColumn("_trusted", F.lit(1))
    )
    grams = (
        docs.select("doc_id", "text")
        .join(F.broadcast(trusted), "doc_id", "left")
        .select("_trusted", _hashes(F.col("text")).alias("_h"))
        .select("_trusted", F.explode(_grams(F.col("_h"), bits)).alias("bucket"))
    )
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("good"))
    counts = Scratch(spark, "quality").save(counts, "counts")
    raw, good = counts.agg(F.sum("raw"), F.sum("good")).first()
    weight = F.log((F.col("good") * F.lit(raw / good if good else 0.0) + F.lit(SMOOTHING)) / (F.col("raw") + F.lit(SMOOTHING)))
    weight = (F.coalesce(weight, F.lit(0.0)) if good else F.lit(0.0)).cast("float")
    # A bucket without a count weighs 0. Slices are gathered by many tasks, then joined in order.
    table = spark.range(1 << bits).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    table = table.select("bucket", weight.alias("w"))
    slices = table.groupBy(F.floor(F.col("bucket") / SLICE).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("all"))
    slices = slices.select("slice", F.transform("all", lambda x: x["w"]).alias("w"))
    joined = F.sort_array(F.collect_list(F.struct("slice", "w")))
    return slices.agg(F.flatten(F.transform(joined, lambda x: x["w"])).alias("weights"))


def score(spark: SparkSession, docs: DataFrame, model: DataFrame, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """Adds llr (0.0 without n-grams) and kept: not base_failed and llr at least ``threshold``.

    A session variable makes the weights one constant of the plan: no join, and no copy a row.
    The plan holds its value, so the variable itself is dropped again.
    """
    name = f"weights_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<FLOAT>")
    spark.sql(f"SET VAR {name} = (SELECT weights FROM {{model}})", model=model)
    weights = F.expr(name)
    a = docs.withColumn("_h", _hashes(F.col("text")))
    a = a.withColumn("_b", _grams(F.col("_h"), bits))
    total = F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.get(weights, b))
    llr = F.when(F.size("_b") > 0, total / F.size("_b")).otherwise(F.lit(0.0))
    a = a.withColumn("llr", llr)
    spark.sql(f"DROP TEMPORARY VARIABLE {name}")
    return a.drop("_h", "_b").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def _judged(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``_row``, doc_id, the base counts, base_failed, llr and kept."""
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    model = Scratch(spark, "quality").save(fit(spark, packed, labels), "model")
    return score(spark, base_counts(packed), model)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept; the model is fitted on ``docs`` themselves.

    One row for each row. Null or empty text has no words and so fails; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    return _judged(spark, docs, labels).drop("_row", "text")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    # A filter on the verdict would be pushed through the projections and nest them into one
    # expression that counts words again for every word; a row number that it needs holds it back.
    judged = _judged(spark, docs, labels).withColumn("_nth", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_nth") >= 0)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(spark, docs, read_table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
