"""Token counts with a shortcut for whole tokens.

The vocabulary's strings that end a word are encoded once by the library: those that come out
as one token are proven to count 1 wherever they stand as a pre-token. Only other pre-tokens
go through the merge list.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import Transducer
from .pieces import MEMO, SETTLED, Memo, apart, cut, distinct, load, packed, span_hashes
from .shared import read_table

#: Tokens beyond which a document is over the limit.
LIMIT = 2048
_STRANGE = regex.compile(rf"[^\x00-\u{SETTLED - 1:04x}]")


class TokenCounter:
    """Counts the tokens of lower-casing word vocabularies as the library does, without special tokens added."""

    def __init__(self, file: str, end: str = "</w>"):
        self.library = load(file)
        self.machine = Transducer(file, end)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        words = []
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            if token.endswith(end):
                try:
                    words.append(self.machine.bytes_of[i].decode())
                except UnicodeDecodeError:
                    continue
        proof = self.library.encode_batch(words, add_special_tokens=False)
        self.whole = [w.encode() for w, p in zip(words, proof, strict=True) if len(p.ids) == 1]
        self.memo = Memo()
        self._forget()

    def _forget(self) -> None:
        self.memo.clear()
        data = b"".join(self.whole)
        ends = np.cumsum([len(w) for w in self.whole])
        h = span_hashes(np.frombuffer(data, np.uint8), np.concatenate(([0], ends[:-1])), ends)
        h = distinct(h)[0]
        self.memo.add(h, np.ones(len(h), np.int32))

    def _normal(self, text: str) -> str:
        """Composed and lower-cased as the library does; by the library itself beyond Latin letters."""
        if text.isascii() or not _STRANGE.search(text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def _counts(self, data: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = span_hashes(np.frombuffer(data, np.uint8), begins, ends)
        h[h == 0] = 1
        found = self.memo.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, where = distinct(h[new])
            where = new[where]
            if self.memo.count + len(keys) > MEMO:
                self._forget()
            spans = zip(begins[where].tolist(), ends[where].tolist(), strict=True)
            counts = np.fromiter((sum(map(len, self.machine.windows(data[b:e]))) for b, e in spans), np.int32, len(keys))
            fresh = self.memo.find(keys) < 0
            self.memo.add(keys[fresh], counts[fresh])
            found[new] = counts[np.searchsorted(keys, h[new])]
        return found

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, marks = apart(texts, self.special)
        total = np.zeros(len(texts), np.int64)
        for k in marks:
            total[owner[k]] += 1
        for of, block in packed(parts):
            data, begins, ends, part = cut([self._normal(t) for t in block], words_only=True)
            to = np.array([owner[k] for k in of])
            for lo in range(0, len(begins), MEMO // 2):
                now = slice(lo, lo + MEMO // 2)
                counts = self._counts(data, begins[now], ends[now])
                total += np.bincount(to[part[now]], weights=counts, minlength=len(texts)).astype(np.int64)
        return total


@functools.cache
def counter(file: str) -> TokenCounter:
    return TokenCounter(file)


def count_documents(docs: DataFrame, file: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text.

    One row for each row; null counts as the empty text, which has 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                    pa.array(own.count(texts)),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(read_table(spark, sf_dir, "documents"))
