"""Runs of words that repeat with a period, by repeated k-gram masking and Main-Lorentz.

A run is a stretch of consecutive words in which words a period apart are identical, of
LEAST_EXPONENT periods and LEAST_LENGTH words at least, that no neighbouring word extends. Shifted by its
period a run overlaps itself in OVERLAP words or more, so each of its words lies in a k-gram of as many
words that the text holds twice. Words outside such k-grams are masked; the segments between
them hold every run whole, and only these are divided and conquered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import mixed
from .shared import CRC_TABLE, WORD, crc32_sql, read_table

#: Words and periods that a run has at least.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: The least overlap of a run with itself one period on, over all periods; beyond LEAST_LENGTH it only grows.
OVERLAP = min(max(LEAST_LENGTH, LEAST_EXPONENT * q) - q for q in range(1, LEAST_LENGTH + 1))
_FOLD = np.uint64(0x9FB21C651E98DF25)


def segments(ids: np.ndarray, k: int = OVERLAP) -> list[tuple[int, int]]:
    """Longest stretches of words that repeated k-grams cover, of LEAST_LENGTH words or more.

    K-grams go by 64-bit hashes: a collision can only leave more words in.
    """
    n = len(ids)
    if n < LEAST_LENGTH:
        return []
    words = ids.astype(np.uint64) + np.uint64(1)
    grams = words[: n - k + 1].copy()
    for j in range(1, k):
        grams = mixed(grams * _FOLD + words[j : n - k + 1 + j])
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(same):
        return []
    begins = np.zeros(n + 1, np.int64)
    begins[order[same]] = 1
    begins[order[same + 1]] = 1
    total = np.cumsum(begins)
    covered = np.zeros(n + 2, np.int8)
    covered[1:-1] = total[:n] > np.concatenate((np.zeros(k, np.int64), total))[:n]
    edges = np.flatnonzero(np.diff(covered))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= LEAST_LENGTH]


def common_prefixes(x: Sequence[int], stop: int) -> list[int]:
    """How many items x[i:] and x share at their begin, for each i below ``stop``."""
    n, left, right = len(x), 0, 0
    out = [n] + [0] * (stop - 1)
    for i in range(1, stop):
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        else:
            k = 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        out[i] = k
        left, right = i, i + k
    return out


def runs(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of ``x``, by start.

    Main-Lorentz: a run within a block that goes over its middle shows there as a common prefix and a
    common suffix of two places a period apart, on the side of the middle where it has a whole
    period. It is kept where no word beside it goes on with it.
    """
    found: dict[tuple[int, int], int] = {}
    blocks = [(0, len(x))]
    while blocks:
        low, high = blocks.pop()
        if high - low < LEAST_LENGTH:
            continue
        middle, most = (low + high) // 2, (high - low) // LEAST_EXPONENT
        blocks += [(low, middle), (middle, high)]
        before, after = x[low:middle], x[middle:high]
        a, b = len(before), len(after)
        back = common_prefixes([*before[::-1], -1, *x[low : middle + most][::-1]], a + 1 + most)
        ahead = common_prefixes([*after, -1, *x[middle - most : high]], b + 1 + most)
        for p in range(1, most + 1):
            left, right = back[a + 1 + most - p], ahead[p]  # places middle and middle + p
            if left + right + p >= max(LEAST_LENGTH, LEAST_EXPONENT * p):
                _keep(found, x, middle - left, middle + p + right, p)
            left, right = back[p], ahead[b + 1 + most - p]  # places middle - p and middle
            if left + right + p >= max(LEAST_LENGTH, LEAST_EXPONENT * p):
                _keep(found, x, middle - p - left, middle + right, p)
    return sorted((start, end - start, p) for (start, end), p in found.items())


def _keep(found: dict[tuple[int, int], int], x: list[int], start: int, end: int, p: int) -> None:
    if start > 0 and x[start - 1] == x[start - 1 + p] or end < len(x) and x[end] == x[end - p]:
        return  # a larger block holds all of it
    found[start, end] = min(p, found.get((start, end), p))


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return sorted((a + s, n, p) for a, b in segments(ids) for s, n, p in runs(ids[a:b].tolist()))


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, period in found:
        drop[start + period : start + length] = True
    return [words[k] for k in np.flatnonzero(~drop).tolist()]


def with_runs(docs: DataFrame) -> DataFrame:
    """(_row, runs, collapsed) of each row of ``docs``: the row itself as a struct, whatever its columns.

    ``runs`` holds (start, length, period) by start, then period, words numbered from 0; ``collapsed`` is the
    text of the words that stay, joined by one space. Null and empty texts have no runs and
    collapse to the empty text. Equal rows get equal results; an empty table gives no rows. A task
    holds one batch of texts; a text of any length is taken whole, in time by its words times the
    logarithm of those that are not masked.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    kind = rows.select("_row", F.lit(None).cast("array<struct<start: bigint, length: bigint, period: bigint>>").alias("runs"), F.lit("").alias("collapsed")).schema
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs, texts = [], []
            for text in batch.column(1):
                # Without an argument bytes are split at the six ASCII white-space characters.
                words = text.as_py().encode().split() if text.is_valid else []
                found = text_runs(words)
                all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(kept_words(words, found)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_runs, pa.list_(run)), pa.array(texts, pa.string())], ["_row", "runs", "collapsed"])

    return rows.mapInArrow(each, kind)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): one row for each run; documents without runs have none."""
    found = with_runs(docs.select("doc_id", "text"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), F.explode("runs").alias("r")).select("doc_id", "r.*")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns; texts with runs are cut to the words that stay, others are left as they are."""
    found = with_runs(docs)
    cut = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("_row.text"))
    return found.select(*[cut.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (nulls without one) and digests of all runs and of the collapsed text."""
    found = with_runs(docs.select("doc_id", "text"))
    more = lambda r, s: r["length"] * s["period"] > s["length"] * r["period"]  # noqa: E731  by start and period before, so ties keep the first
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda s, r: F.when(more(r, s), r).otherwise(s))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    shown = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = found.select("_row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(shown, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * b.length div b.period")
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of all ids repeat a few words from some word on.

    h is the CRC-32 of the id in decimal, g = h div 10. Where 10 divides h, each word from number a = g mod n on becomes
    word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Without an id or words nothing changes.
    """
    h: Column = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.expr("crc32(CAST(doc_id AS STRING)) div 10").alias("g"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform("w", lambda _, i: F.get("w", at(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


#: Equal 5-grams a period apart, in unbroken stretches, are runs of four words more and a period. 232792560, which the
#: numbers to 20 divide, keeps exponents apart that differ little.
SQL = rf"""
WITH {CRC_TABLE},
x AS (SELECT doc_id, hex(encode(doc_id::VARCHAR)) AS s, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS o FROM documents),
y AS (SELECT row_number() OVER () AS r, doc_id, o, len(o) AS n, {crc32_sql('s')} AS h FROM x, t),
a AS (SELECT r, doc_id, o, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) ELSE 1 END AS p FROM y),
w AS (SELECT r, doc_id, n, list_transform(range(0, n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) AS w FROM a),
u AS (SELECT r, n, i, w[i + 1] AS word, array_to_string(w[i + 1:i + 5], chr(10)) AS gram FROM w, LATERAL (SELECT unnest(range(0, n)) AS i)),
g AS (SELECT * FROM u WHERE i + 5 <= n),
m AS (SELECT b.r, b.i, c.i - b.i AS q FROM g b JOIN g c ON c.r = b.r AND c.gram = b.gram AND c.i > b.i AND 4 * (c.i - b.i) <= b.n),
l AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
s AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM l GROUP BY r, q, island),
f AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
t1 AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shown FROM f GROUP BY 1),
t2 AS (SELECT r, start, length, period FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY length * 232792560 // period DESC, (length * 232792560 % period)::DOUBLE / period DESC, start, period) = 1),
t3 AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM f),
t4 AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN t3 USING (r, i) GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN t1 USING (r) LEFT JOIN t2 USING (r) LEFT JOIN t4 USING (r)
"""
