"""Spelling variants: words one edit apart, found by bands of letter-parity bitmasks.

A word's mask has a bit for each letter, set where the word holds the letter an odd number of
times. Inserting or deleting a letter flips one bit, replacing one flips two, so of three bands of
a mask at least one stays as it is. Words meet that have an equal band and lengths at most one
apart; every such pair is verified. Letters are few, so the words of one band's value grow with
the vocabulary; each such group is split exactly, by halves: an edit leaves the shorter word's
first or last half alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CRC_TABLE, LOWER, UPPER, Scratch, crc32_sql, read_table

#: Letters of a run: ASCII and Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points that a word has at least, and how often it occurs at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A near word that occurs so many times as often is the form of a word.
DOMINANCE = 10
#: Bands of a mask: one more than the bits that one edit flips.
BANDS = 3


def word_counts(runs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the column ``word``; shorter, rarer and null words go. Counts fold before the shuffle."""
    counts = runs.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def text_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, word): every run of at least so many letters of every whole text, A-Z lower-cased; null text has none."""
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))


def masks(word: Column) -> Column:
    """One long a band: the parities of the letters whose code points leave its number modulo BANDS."""
    points = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    # From "a" to U+00FF each band has 53 letters; those beyond would share bits, which costs candidates only.
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(c / BANDS) - F.lit(97 // BANDS), F.lit(64)).cast("int"))
    band = lambda b: F.aggregate(F.filter(points, lambda c: c % BANDS == b), F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(bit(c)))
    return F.array(*[band(b) for b in range(BANDS)])


def _half(word: Column, n: Column, side: int) -> Column:
    """The first or last half of a word, cut as for a shorter word of n code points."""
    first = F.floor(n / 2).cast("int")
    return F.substring(word, F.lit(1), first) if side == 0 else F.right(word, n - first)


def near_pairs(spark: SparkSession, words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of different words that are one edit apart, each once.

    ``words`` (word, n) holds each word once. A word is asked for as the shorter (or equal) one of
    a pair by its own length, and offered by its length and as the longer one. A pair that shares
    several keys is verified at the first of them only.
    """
    masked = scratch.save(words.select("word", "n", F.char_length("word").cast("int").alias("length"), masks(F.col("word")).alias("mask")), "masks")
    sides, bands = (0, 1), range(BANDS)

    def keyed(rows: DataFrame, short: Column) -> DataFrame:
        keys = [
            F.struct(F.lit(b).alias("band"), F.lit(side).alias("side"), F.xxhash64(F.lit(b), F.get("mask", F.lit(b)), short, F.lit(side), _half(F.col("word"), short, side)).alias("key"))
            for b in bands
            for side in sides
        ]
        return rows.select("word", "n", "length", "mask", F.explode(F.array(*keys)).alias("k")).select("word", "n", "length", "mask", "k.*")

    length = F.col("length")
    asked = keyed(masked, length)
    offered = asked.unionByName(keyed(masked, length - 1))
    a, b = asked.alias("a"), offered.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.side") == F.col("b.side")))
    # Equal lengths: one order of the two. The key of an offered word as the longer one has the length before it.
    gap = F.col("b.length") - F.col("a.length")
    met = met.where((gap == 1) | (gap == 0) & (F.col("a.word") < F.col("b.word")))
    flips = [F.bit_count(F.get("a.mask", F.lit(k)).bitwiseXOR(F.get("b.mask", F.lit(k)))) for k in bands]
    met = met.where(sum(flips[1:], flips[0]) < BANDS)
    same = [f == 0 for f in flips]
    first = _half(F.col("a.word"), F.col("a.length"), 0) == _half(F.col("b.word"), F.col("a.length"), 0)
    for k in bands:  # equal keys of other bands or halves are collisions of hashes
        met = met.where((F.col("a.band") > k) & ~same[k] | (F.col("a.band") == k) & same[k] | (F.col("a.band") < k))
    met = met.where((F.col("a.side") == 0) & first | (F.col("a.side") == 1) & ~first)
    met = met.where(F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def variants(spark: SparkSession, words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (word, n).

    The form is the near word of largest n, the first by code points of several, if it occurs at
    least ``dominance`` times as often; else null. The root is the last of the forms that follow
    from a word, itself without one. Each form is more frequent than the word before it by the
    factor, so there are few of them in a row. A word of m letters has some hundred times m
    near words at most, whatever the vocabulary. An empty table gives no rows.
    """
    scratch = Scratch(spark, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    pairs = scratch.save(near_pairs(spark, words, scratch), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("o"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near")).alias("o")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("o"))
    found = words.join(near, "word", "left")
    most = -F.col("o.less")
    strong = most >= dominance * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("o.near")).alias("form"), F.when(strong, most).alias("form_n"))
    found = scratch.save(found, "forms")
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    k = 0
    while True:  # each round doubles the steps that a word is ahead
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = scratch.save(steps.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), f"roots-{k}")
        moved = steps.where("_moved").limit(1).count()
        steps = steps.select("word", "root")
        k += 1
        if not moved:
            break
    scratch.drop("words", "masks", "pairs", *[f"roots-{j}" for j in range(k - 1)])
    return found.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def normalised(spark: SparkSession, docs: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, word, root): the words of all texts that have another root by ``forms`` (word, root), folded with their number ``n``.

    Null ids are kept as such; texts without such words give no rows.
    """
    asked = text_words(docs).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(forms.where("word <> root").select("word", "root"), "word").select("doc_id", "word", "root", "n")


def with_planted_slips(words: DataFrame) -> DataFrame:
    """(word): the rows of (doc_id, word), a 31st of which lose a letter by a hash of id and word.

    h is the CRC-32 of "<doc_id>:<word>"; where 31 divides it, letter h mod length goes. A null id
    counts as the empty string.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    rows = words.select("word", h.alias("h"))
    at = F.pmod("h", F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    return rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("word")).alias("word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = variants(spark, word_counts(with_planted_slips(text_words(docs))))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, w, count(*) AS n FROM r GROUP BY 1, 2),
x AS (SELECT w, n, hex(encode(d || ':' || w)) AS s FROM g),
h AS (SELECT w, n, {crc32_sql('s')} AS h FROM x, t),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
o AS (SELECT word, count(*) AS n_near, max(m) AS best FROM p GROUP BY 1),
f AS (SELECT p.word, min(near) AS near, any_value(n_near) AS n_near, any_value(best) AS best FROM p JOIN o ON o.word = p.word AND p.m = o.best GROUP BY 1),
k AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 10 * v.n THEN near END AS form, CASE WHEN best >= 10 * v.n THEN best END AS form_n FROM v LEFT JOIN f USING (word)),
z AS (SELECT word, word AS root, 0 AS depth FROM k UNION ALL SELECT z.word, k.form, depth + 1 FROM z JOIN k ON k.word = z.root WHERE k.form IS NOT NULL),
e AS (SELECT word, arg_max(root, depth) AS root FROM z GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM k JOIN e USING (word)
"""
