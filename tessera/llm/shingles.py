"""Hashed word shingles of whole texts by array operations, and a sketch of their frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import BLOCK, mixed, span_hashes
from .shared import text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.uint64(0x9FB21C651E98DF25)
_SHORT = np.uint64(0xA0761D6478BD642F)

#: Counters of the frequency sketch as powers of two: the least, and the most (16 MB, an eighth of
#: a map task's input, which is also what the driver sums up and broadcasts).
LEAST_BITS, MOST_BITS = 20, 22
#: Bytes of text for one counter between these.
BYTES_EACH = 384
#: Sums of counters that one task adds up, a branch of the tree.
BRANCHES = 256
#: Counters that travel in one row.
SLICE = 1 << 14


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null takes no bytes."""
    column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data and len(data) else np.zeros(0, np.uint8)), at.astype(np.int64)


def _words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts within ``bounds`` of ``data``, and where each text's begin."""
    low = int(bounds[0])
    block = _LOWER[data[low : int(bounds[-1])]]
    if not len(block):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = _IS_SPACE[block]
    before, after = np.empty(len(block), bool), np.empty(len(block), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    first = bounds[:-1] - low
    before[first[first < len(block)]] = True
    last = bounds[1:] - low - 1
    after[last[last >= 0]] = True
    before[0] = after[-1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return span_hashes(block, starts, ends), np.searchsorted(starts, bounds - low)


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its words in order; A-Z count as a-z."""
    data, at = _text_buffers(column)
    k, n = 0, len(at) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK, side="right")) - 1)
        if j == k + 1 and at[j] - at[k] > BLOCK:
            found, low = [], int(at[k])
            while low < at[j]:
                high = min(low + BLOCK, int(at[j]))
                while high < at[j]:
                    space = np.flatnonzero(_IS_SPACE[data[low:high]])
                    if len(space):
                        high = low + int(space[-1]) + 1
                        break
                    high = min(high + BLOCK, int(at[j]))
                found.append(_words_of(data, np.array([low, high]))[0])
                low = high
            yield np.concatenate(found)
        else:
            h, cut = _words_of(data, at[k : j + 1])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                yield h[a:b]
        k = j


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's windows of ``width`` words; a shorter text is one shingle."""
    n = len(words)
    if n == 0:
        return words
    size = min(width, n)
    acc = words[: n - size + 1].copy()
    for j in range(1, size):
        acc = mixed(acc * _FOLD + words[j : n - size + 1 + j])
    if n < width:
        acc = mixed(acc ^ (_SHORT >> np.uint64(n)))
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def sketch_bits(docs: DataFrame) -> int:
    """Counters for all texts of a table, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (text_bytes(docs) // BYTES_EACH).bit_length()))


def frequency_sketch(spark: SparkSession, docs: DataFrame, width: int, bits: int | None = None) -> np.ndarray:
    """Upper bounds, by hash, of how many texts hold a shingle, over all texts.

    Each task counts into 2^bits counters; slices of them are summed in parallel tasks, one row
    of each at a time, in as many levels as there are tasks to sum. What reaches the driver is
    4 * 2^bits bytes.
    """
    bits = bits or sketch_bits(docs)
    slices = max(1, (1 << bits) // SLICE)
    size = (1 << bits) // slices
    kind = "slice int, branch int, counts binary"

    def packed(k: int, branch: int, counts: np.ndarray) -> pa.RecordBatch:
        rows = [pa.array([k], pa.int32()), pa.array([branch], pa.int32()), pa.array([counts.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(rows, ["slice", "branch", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask = np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1)
        for batch in batches:
            for words in word_hashes(batch.column(0)):
                counts[(shingle_set(words, width) & mask).astype(np.int64)] += 1
        task = TaskContext.get().partitionId()
        for k in np.flatnonzero(counts.reshape(slices, size).any(1)).tolist():
            yield packed(k, task, counts[k * size : (k + 1) * size])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, branch, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(row.as_buffer(), np.int32)
                if (k, branch) in sums:
                    sums[k, branch] += part
                else:
                    sums[k, branch] = part.astype(np.int64)
        for (k, branch), v in sums.items():
            yield packed(k, branch, np.minimum(v, np.iinfo(np.int32).max).astype(np.int32))

    texts = docs.select("text")
    parts, tasks = texts.mapInArrow(count, kind), texts._jdf.queryExecution().toRdd().getNumPartitions()
    while True:
        tasks = max(1, -(-tasks // BRANCHES))
        parts = parts.withColumn("branch", F.floor(F.col("branch") / BRANCHES).cast("int"))
        parts = parts.repartition(min(slices * tasks, 4096), "slice", "branch").mapInArrow(total, kind)
        if tasks == 1:
            break
    out = np.zeros(1 << bits, np.int32)
    for k, _, row in parts.collect():
        out[k * size : (k + 1) * size] = np.frombuffer(row, np.int32)
    return out
