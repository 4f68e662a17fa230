"""Cutting texts into pre-tokens by array operations, and a bounded table keyed by their hashes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
import xxhash
from tokenizers import Tokenizer

#: Characters that are cut at once.
BLOCK = 1 << 18
#: Entries that a memo table of one worker holds before it starts anew.
MEMO = 1 << 20
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Below this code point Unicode's classes have long been settled; above, the library itself is asked.
SETTLED = 0x250
_BREAK = regex.compile(r"(?<=\S)\s")
#: Spans of more bytes are hashed one by one: sums of powers modulo 2^64 have fixed collisions in long words.
SUMMED = 16


def segments(text: str, limit: int = BLOCK) -> Iterator[str]:
    """Parts of ``text`` that can be cut into pre-tokens each by itself.

    They begin at white space after visible text, where every pre-token ends; a part is only
    as long as it must be where ``limit`` characters hold no such place.
    """
    at = 0
    while len(text) - at > limit:
        found = _BREAK.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def packed(texts: list[str], limit: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """The segments of all texts in blocks of about ``limit`` characters, with their texts' positions."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        for part in segments(text, limit):
            if parts and size + len(part) > limit:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(k)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def apart(texts: list[str], special: dict[str, int]) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts without the special strings in them: the parts between, their texts' positions, and
    the id of the special string after a part."""
    parts: list[str] = []
    owner: list[int] = []
    marks: dict[int, int] = {}
    pattern = regex.compile("|".join(map(regex.escape, special))) if special else None
    for k, text in enumerate(texts):
        at = 0
        for found in pattern.finditer(text) if pattern and any(s in text for s in special) else ():
            marks[len(parts)] = special[found.group()]
            parts.append(text[at : found.start()])
            owner.append(k)
            at = found.end()
        parts.append(text[at:] if at else text)
        owner.append(k)
    return parts, owner, marks


@functools.cache
def load(name: str) -> Tokenizer:
    """A public tokenizer by the name of its file."""
    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, UNKNOWN, np.uint8)
    for c in range(SETTLED):
        table[c] = _ask(chr(c))
    return table


def _ask(char: str) -> int:
    """The class that the library's own splitter gives a character."""
    cut = load("byte_bpe_50k.json").pre_tokenizer.pre_tokenize_str
    for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        if len(cut(probe + char)) == 1:
            return kind
    return SPACE


_POWER = 0x9E3779B97F4A7C15
_mix = np.uint64(0xFF51AFD7ED558CCD)


def _splitmix(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(_POWER)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTE = _splitmix(256)
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * BLOCK)
        for k, base in enumerate((_POWER, pow(_POWER, -1, 1 << 64))):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes: one running sum over all bytes, two look-ups a span.

    Spans over SUMMED bytes go through xxh3 each.
    """
    power, inverse = _grow(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = mixed(h)
    long = np.flatnonzero(ends - starts > SUMMED)
    if len(long):
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        spans = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        h[long] = np.fromiter((digest(view[a:b]) for a, b in spans), np.uint64, len(long))
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _mix
    return h ^ (h >> np.uint64(32))


def cut(parts: list[str], words_only: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of each part: the parts' bytes joined, spans in them, and each span's part.

    With ``words_only``, runs of letters, single digits and runs of other visible characters;
    white space goes. Else runs of letters, of digits and of others, each with the space
    before it, and white space. Both hold the English endings after an apostrophe apart.
    """
    joined = "".join(parts)
    data = joined.encode()
    plain = len(data) == len(joined)
    points = np.frombuffer(data, np.uint8) if plain else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return data, none, none, none
    table = _classes()
    kind = table[points]
    if not plain and (strange := kind == UNKNOWN).any():
        for c in set(points[strange].tolist()):
            table[c] = _ask(chr(c))
        kind = table[points]
    firsts = np.cumsum([0, *map(len, parts)])
    inner = firsts[:-1][firsts[:-1] < n]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[inner] = True
    space = kind == SPACE
    if words_only:
        start |= kind == NUMBER
    else:
        # White space before visible text of the same part: its last character stands alone, or joins the text if it is a space.
        last = np.flatnonzero(space[:-1] & ~space[1:])
        edge = np.zeros(n + 1, bool)
        edge[firsts] = True
        last = last[~edge[last + 1]]
        start[last] = True
        start[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero(points == 39)
    quote = quote[start[quote] & (quote + 1 < n)]
    if len(quote):
        part_end = firsts[np.searchsorted(firsts, quote, side="right")]
        a = points[quote + 1]
        b = points[np.minimum(quote + 2, n - 1)]
        one = (quote + 1 < part_end) & ((a == 115) | (a == 116) | (a == 109) | (a == 100))
        two = (quote + 2 < part_end) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        for which, size in ((one, 2), (two & ~one, 3)):
            q = quote[which]
            start[q + 1] = False
            after = q + size
            start[after[after < n]] = True
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], n)
    if words_only:
        seen = ~space[begins]
        begins, ends = begins[seen], ends[seen]
    owner = np.searchsorted(firsts, begins, side="right") - 1
    if not plain:
        size = np.ones(n, np.int64)
        size += points > 0x7F
        size += points > 0x7FF
        size += points > 0xFFFF
        at = np.concatenate(([0], np.cumsum(size)))
        begins, ends = at[begins], at[ends]
    return data, begins, ends, owner


class Memo:
    """Positions of known pre-tokens by hash: open addressing in two arrays, at most half full."""

    def __init__(self, most: int = MEMO):
        self.most, self.mask = most, np.uint64(2 * most - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(2 * self.most, np.uint64)
        self.values = np.zeros(2 * self.most, np.int32)
        self.count = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((key != h) & (key != 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + np.uint64(1)) & self.mask
            key, want = self.keys[slot], h[rest]
            hit = key == want
            out[rest[hit]] = self.values[slot[hit]]
            go = ~hit & (key != 0)
            rest, slot = rest[go], slot[go]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """``h``: distinct hashes that are not there yet."""
        self.count += len(h)
        slot = h & self.mask
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.values[slot[won]] = values[won]
            h, values, slot = h[~won], values[~won], (slot[~won] + np.uint64(1)) & self.mask


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and, for each, one position in ``h``."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    return s[new], order[new]
