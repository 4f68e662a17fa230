"""Byte-pair encoding as a streaming transducer of bounded lookahead, and incremental decoding.

Whether a merge takes place can depend on text to its right only through a chain of merges of
ever lower rank, each consuming the token that the one before it needs. The longest such chain
bounds the bytes that must be seen after a token before it is final (its lookahead). So a
pre-token of any length is encoded in windows: tokens that end a lookahead before the window's
end are emitted and the next window begins there.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pieces import Memo, apart, cut, distinct, load, packed, span_hashes
from .shared import read_table


#: Pre-tokens whose ids a worker remembers before it starts anew, some 200 bytes each.
MEMO = 1 << 18


@functools.cache
def byte_chars() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[str, str]], size: Callable[[str], int] = len) -> int:
    """Bytes after a token's end that can bear on it, from the merge list (lowest rank first).

    Let reach[t] be the longest chain that starts right of a token t, over merges so far: a
    merge (t, c) of rank r adds the bytes of c and goes on right of c, or right of any token
    that c ends in, with ranks below r. Going through the list in rank order, each reach is
    known when used.
    """
    reach: dict[str, int] = {}
    last_parts: dict[str, list[str]] = {}

    def beyond(token: str) -> int:
        return max([reach.get(token, 0), *map(beyond, last_parts.get(token, ()))])

    longest = 0
    for left, right in merges:
        far = size(right) + beyond(right)
        reach[left] = max(reach.get(left, 0), far)
        last_parts.setdefault(left + right, []).append(right)
        longest = max(longest, far)
    return longest


class Transducer:
    """Encodes bytes with one vocabulary; ``windows`` streams, ``encode`` collects.

    ``end``: the mark of a word's last character in the vocabulary, if it has one.
    """

    def __init__(self, file: str, end: str = ""):
        model = json.load(open(public_tokenizers.path(file), encoding="utf-8"))["model"]
        vocab: dict[str, int] = model["vocab"]
        chars = byte_chars()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.first = {b: vocab[c] for c, b in chars.items()}
        self.last = {b: vocab[c + end] for c, b in chars.items()}
        self.end = end
        raw = lambda t: bytes(chars[c] for c in (t[: -len(end)] if end and t.endswith(end) else t))
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead(pairs, lambda t: len(raw(t)))
        self.longest = max(map(len, self.bytes_of.values()))
        self.window = 4 * (self.lookahead + self.longest)

    def _merge(self, ids: list[int]) -> list[int]:
        ranks = self.ranks
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = None
            for k in range(len(ids) - 1):
                found = ranks.get((ids[k], ids[k + 1]))
                if found and (best is None or found[0] < best[0]):
                    best, at = found, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs, for many bytes."""
        ranks, n = self.ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(f[0], k, f[1], ids[k], ids[k + 1]) for k in range(n - 1) if (f := ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(queue)
        while queue:
            _, k, new, a, b = heapq.heappop(queue)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if f := ranks.get((new, ids[m])):
                    heapq.heappush(queue, (f[0], k, f[1], new, ids[m]))
            if (i := before[k]) >= 0 and (f := ranks.get((ids[i], new))):
                heapq.heappush(queue, (f[0], i, f[1], ids[i], new))
        return [i for i in ids if i >= 0]

    def windows(self, piece: bytes) -> Iterator[list[int]]:
        """Ids of one pre-token, emitted as soon as they are final."""
        at, n = 0, len(piece)
        while n - at > self.window:
            ids = self._merge([self.first[b] for b in piece[at : at + self.window]])
            end, out, stable = 0, [], self.window - self.lookahead - self.longest
            for i in ids:
                size = len(self.bytes_of[i])
                if end + size > stable:
                    break
                end += size
                out.append(i)
            yield out
            at += end
        rest = piece[at:]
        if rest:
            yield self._merge([*(self.first[b] for b in rest[:-1]), self.last[rest[-1]]])

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) <= self.window:
            return self._merge([*(self.first[b] for b in piece[:-1]), self.last[piece[-1]]])
        return [i for ids in self.windows(piece) for i in ids]


class TextDecoder:
    """Ids to text bit by bit: holds back the bytes of a character until it is whole.

    Bytes that can't be part of one become U+FFFD.
    """

    def __init__(self, table: list[bytes]):
        self.table, self.state = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class ByteCodec:
    """Encoder and decoder of a byte-level tokenizer, with a memo of pre-tokens of bounded size.

    The special strings of the vocabulary inside a text are one token each, as in the library.
    """

    def __init__(self, file: str):
        self.machine = Transducer(file)
        self.special = {t.content: i for i, t in load(file).get_added_tokens_decoder().items()}
        size = max([*self.machine.bytes_of, *self.special.values()]) + 1
        self.table = [b""] * size
        for i, raw in self.machine.bytes_of.items():
            self.table[i] = raw
        for text, i in self.special.items():
            self.table[i] = text.encode()
        self.shown = [b"%d," % i for i in range(size)]
        self.memo = Memo(MEMO)
        self._forget()

    def _forget(self) -> None:
        self.memo.clear()
        self.ids: list[list[int]] = []
        self.text: list[bytes] = []

    def _known(self, data: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions in the memo of the spans' bytes; new ones are encoded."""
        h = span_hashes(np.frombuffer(data, np.uint8), begins, ends)
        h[h == 0] = 1
        found = self.memo.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, where = distinct(h[new])
            if self.memo.count + len(keys) > MEMO:
                self._forget()
                keys, where = distinct(h)
                new = np.arange(len(h))
            where = new[where]
            base = len(self.ids)
            for b, e in zip(begins[where].tolist(), ends[where].tolist(), strict=True):
                ids = self.machine.encode(data[b:e])
                self.ids.append(ids)
                self.text.append(b"".join([self.shown[i] for i in ids]))
            self.memo.add(keys, np.arange(base, base + len(keys), dtype=np.int32))
            found = self.memo.find(h)
        return found

    def blocks(self, texts: list[str]) -> Iterator[tuple[int, list[int], bytes]]:
        """(position of a text, ids, ids in decimal with a comma after each) bit by bit, in order."""
        plain, owner, marks = apart(texts, self.special)
        done = 0  # parts before this one have given all, marks included
        for parts_of, parts in packed(plain):
            data, begins, ends, part = cut(parts, words_only=False)
            for lo in range(0, len(begins), MEMO // 2):
                now = slice(lo, lo + MEMO // 2)
                at, own = self._known(data, begins[now], ends[now]).tolist(), part[now]
                first, last = int(own[0]), int(own[-1]) + 1
                bounds = np.searchsorted(own, np.arange(first, last + 1)).tolist()
                for p in range(first, last):
                    k = parts_of[p]
                    while done < k:
                        if done in marks:
                            yield owner[done], [marks[done]], self.shown[marks[done]]
                        done += 1
                    got = at[bounds[p - first] : bounds[p - first + 1]]
                    yield owner[k], [i for x in got for i in self.ids[x]], b"".join([self.text[x] for x in got])
        while done < len(plain):
            if done in marks:
                yield owner[done], [marks[done]], self.shown[marks[done]]
            done += 1

    def encode(self, text: str) -> list[int]:
        return [i for _, ids, _ in self.blocks([text]) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        decoder = TextDecoder(self.table)
        return decoder.feed(ids) + decoder.finish()


@functools.cache
def codec(file: str) -> ByteCodec:
    return ByteCodec(file)


def encode_documents(docs: DataFrame, file: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded again.

    One row for each row; null counts as the empty text, which has no ids. Ids and text are
    hashed as they come, so that a task holds one batch of texts and little else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            count = [0] * len(texts)
            ids_hash, text_hash = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            decoders = [None] * len(texts)
            for k, ids, shown in own.blocks(texts):
                if not ids:
                    continue
                ids_hash[k].update(b"," + shown[:-1] if count[k] else shown[:-1])
                count[k] += len(ids)
                decoders[k] = decoders[k] or TextDecoder(own.table)
                text_hash[k].update(decoders[k].feed(ids).encode())
            for k, decoder in enumerate(decoders):
                if decoder:
                    text_hash[k].update(decoder.finish().encode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count, pa.int64()),
                    pa.array([h.hexdigest() for h in ids_hash]),
                    pa.array([h.hexdigest() for h in text_hash]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
