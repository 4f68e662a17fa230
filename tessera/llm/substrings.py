"""Substring dedup by content-defined chunks that are deduplicated by digest.

A gear hash rolls over a text's bytes and spans the last SPAN of them. A word ends a chunk if its
hash there is the least within REACH words on both sides, so a boundary depends on a few words
around it only and insertions elsewhere move none. From every boundary a chunk goes on to the
first boundary at least ``least_words`` words on; it is known by the digest of its words.
Chunks overlap, so a passage needs no luck with where the one before it began, and a shared
digest means that many words in a row are shared. Chunks that several documents hold are
joined to passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import BLOCK, _grow, _splitmix, mixed, span_hashes
from .shared import Scratch, join_folded, read_table
from .shingles import _IS_SPACE

#: Words on each side among which a boundary's hash is the least.
REACH = 2
#: Words that a chunk has at least. Passages of twice as many words hold a whole one.
LEAST_WORDS = 24
#: Bytes that the rolling hash spans: as many as it has bits.
SPAN = 16

_GEAR = (_splitmix(512)[256:] >> np.uint64(48)).astype(np.uint16)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2h + G[byte] of 16 bits after each byte, by doubling its span."""
    h = _GEAR[data]
    size = 1
    while size < SPAN:
        h[size:] += h[:-size].copy() << np.uint16(size)
        size *= 2
    return h


def boundaries(h: np.ndarray) -> np.ndarray:
    """Whether each word ends a chunk, from the hashes at the words' ends; beyond them nothing is smaller.

    Equal hashes are boundaries alike, so words that repeat in short periods have some too.
    """
    wide = np.full(len(h) + 2 * REACH, 1 << 16)
    wide[REACH : REACH + len(h)] = h
    least = np.ones(len(h), bool)
    for d in (*range(-REACH, 0), *range(1, REACH + 1)):
        least &= h <= wide[REACH + d : REACH + d + len(h)]
    return least


def chunks(data: np.ndarray, least_words: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """Place (first word), words, begin, bytes and digest of a text's chunks, block by block."""
    starts, ends, words = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.zeros(0, np.int64)
    place = low = first = 0  # the text's words before the pending ones, bytes read, where the next chunk begins
    while low < len(data):
        high = low
        while True:
            high = min(high + block, len(data))
            spaces = np.flatnonzero(_IS_SPACE[data[low:high]]) if high < len(data) else ()
            if high == len(data) or len(spaces):
                break
        high = low + int(spaces[-1]) + 1 if len(spaces) else high
        part, before = data[low:high], min(low, SPAN)
        space = np.concatenate(([True], _IS_SPACE[part], [True]))
        begin, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        rolled = gear(data[low - before : high])[before:]
        starts, ends = np.concatenate((starts, begin + low)), np.concatenate((ends, end + low))
        words, hashes = np.concatenate((words, span_hashes(part, begin, end))), np.concatenate((hashes, rolled[end - 1]))
        low, n = high, len(words)
        if not n:
            continue
        least = boundaries(hashes)
        if low < len(data):
            least[max(0, n - REACH) :] = False  # what follows may hold smaller ones
        else:
            least[-1] = True
        last = first + np.flatnonzero(least[first:])
        start = np.concatenate(([first], last + 1))
        at = np.searchsorted(last, start + least_words - 1)
        done = int(np.searchsorted(at, len(last)))
        start, at = start[:done], last[at[:done]]
        if done:
            power, inverse = _grow(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(words * power[:n], out=total[1:])
            size = at - start + 1
            digest = mixed((total[at + 1] - total[start]) * inverse[start] + size.astype(np.uint64) * _LENGTH)
            yield place + start, size, starts[start], ends[at] - starts[start], digest
            # The next chunk begins after the first boundary beyond the last start.
            first = int(last[np.searchsorted(last, start[-1])]) + 1
        gone = max(0, first - REACH)
        starts, ends, words, hashes = starts[gone:], ends[gone:], words[gone:], hashes[gone:]
        place, first = place + gone, first - gone


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for k, text in enumerate(column):
        if text.is_valid:
            yield k, np.frombuffer(text.as_buffer(), np.uint8)


def _document(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that stand for a document: its id and its text, since ids may repeat; equal texts without an id are one."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def held_chunks(spark: SparkSession, docs: DataFrame, scratch: Scratch, least_words: int) -> DataFrame:
    """(doc_id, document, place, n, begin, bytes, first_doc_id) of the chunks that another document holds too.

    Null text and texts of fewer words have none.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "document", "place", "n", "begin", "bytes", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0

            def flush():
                owner, *cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                cols = [pa.array(c.astype(t)) for c, t in zip(cols[:-1], ("i4", "i4", "i8", "i4"), strict=True)] + [pa.array(cols[-1].view(np.int64))]
                owner = pa.array(owner)
                return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *cols], names)

            for k, data in _texts(batch.column(2)):
                for found in chunks(data, least_words):
                    out.append((np.full(len(found[0]), k), *found))
                    held += len(found[0])
                    if held > BLOCK // 4:
                        yield flush()
                        out, held = [], 0
            if out:
                yield flush()

    schema = f"doc_id {kind}, document bigint, place int, n int, begin bigint, bytes int, digest bigint"
    cut = scratch.save(docs.select("doc_id", _document().alias("document"), "text").mapInArrow(run, schema), "chunks")
    # Folded inside each task before the digests are shuffled, so a chunk of many documents is few rows.
    same = cut.groupBy("digest").agg(
        F.min("document").alias("lo"), F.max("document").alias("hi"), F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("rows")
    )
    shared = scratch.save(same.where("lo < hi").select("digest", "first_doc_id", "rows"), "shared")
    return join_folded(cut, shared, "digest", "rows", cut.count()).drop("digest", "rows")


def _joined(held: DataFrame) -> DataFrame:
    """The passages of chunks that overlap or touch, with the document they lie in."""
    by_doc = Window.partitionBy("document", "doc_id").orderBy("place")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("place") + F.col("n")
    earlier = F.when(F.col("first_doc_id") < F.col("doc_id"), end)
    fresh = end - F.greatest(F.col("place"), F.coalesce(F.max(earlier).over(so_far), F.lit(0)))
    rows = held.select(
        "*",
        F.coalesce(F.col("place") > F.max(end).over(so_far), F.lit(True)).alias("apart"),
        F.coalesce(F.col("place") > F.lag("place").over(by_doc), F.lit(True)).alias("new"),
        F.when(earlier.isNotNull(), F.greatest(fresh, F.lit(0))).otherwise(0).alias("repeats"),
    )
    runs = rows.withColumn("run", F.count_if("apart").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "document", "run").agg(
        F.min("begin").alias("begin"),
        F.max(F.col("begin") + F.col("bytes")).alias("end"),
        (F.max(end) - F.min("place")).cast("long").alias("n_words"),
        F.count_if("new").alias("n_chunks"),
        F.min("first_doc_id").alias("first_doc_id"),
        F.sum("repeats").cast("long").alias("repeat_words"),
    ).drop("run")


def passages(spark: SparkSession, docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of ``least_words`` words or more that other documents hold too.

    doc_id, begin and end (bytes in UTF-8), n_words, n_chunks, first_doc_id (the smallest doc_id
    that holds a part of it) and repeat_words (words in chunks that a smaller doc_id holds, which
    dedup takes away). Words are compared, the white space between them is not. A document is
    a doc_id with a text: fully repeated rows are one, rows of one id with different texts are
    two. What only one document repeats is no passage. Documents without a passage have no
    row; rows without a doc_id are documents too; an empty table gives no rows.
    """
    scratch = Scratch(spark, "substrings")
    found = scratch.save(_joined(held_chunks(spark, docs, scratch, least_words)).drop("document"), "passages")
    scratch.drop("chunks", "shared")
    return found


def _free(names: list[str], name: str) -> str:
    """A column name that is not taken, whatever its case."""
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name


def without_repeats(spark: SparkSession, docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the passages cut out that a smaller doc_id holds; all columns stay.

    Only words of chunks that a smaller doc_id holds go, so each stays where it comes first.
    """
    names, key, cut = docs.columns, _free(docs.columns, "document"), _free(docs.columns, "cut")
    held = held_chunks(spark, docs, Scratch(spark, "substrings"), least_words)
    spans = _joined(held.where("first_doc_id < doc_id"))
    by_doc = spans.groupBy(F.col("document").alias(key)).agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("begin", "end")))).alias(cut))
    both = docs.withColumn(key, _document()).join(by_doc, key, "left").select(*names, cut)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if cut:
                    raw, low, parts = text.encode(), 0, []
                    for span in cut:
                        parts.append(raw[low : span["begin"]])
                        low = span["end"]
                    text = b"".join([*parts, raw[low:]]).decode()
                texts.append(text)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, read_table(spark, sf_dir, "documents"))
