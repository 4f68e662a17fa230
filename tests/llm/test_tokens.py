"""Token counts and the BPE transducer against the library, and on hostile texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, pieces, shingles, substrings, token_counts

ODD = ["", " ", "a", "it's we'll 's''s '", "x" * 9000, "ab" * 3000, "1a" * 4000, " " * 3000 + "a\n\n b", "ÉTÉ Σας ΟΔΟΣ İ ﬁ ²", "中文 文字，🙂👩‍👩‍👧", "<|endoftext|>a<|startoftext|> b<|endoftext|>", "\x00\x1c  ́é�", "٣ก็ " * 50]
TEXT = st.text(st.characters(codec="utf-8"), max_size=60)


@pytest.fixture(scope="module")
def tools():
    return bpe.codec("byte_bpe_50k.json"), token_counts.counter("word_bpe_49k.json"), pieces.load("byte_bpe_50k.json"), pieces.load("word_bpe_49k.json")


def encode_all(codec, texts):
    out = [[] for _ in texts]
    for k, ids, shown in codec.blocks(texts):
        assert shown == b"".join(b"%d," % i for i in ids)
        out[k] += ids
    return out


def test_encoding_equals_the_library(tools):
    codec, _, library, _ = tools
    want = [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert encode_all(codec, ODD) == want
    assert [codec.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_counts_equal_the_library(tools):
    _, counter, _, library = tools
    assert counter.count(ODD).tolist() == [len(e.ids) for e in library.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_any_text(tools, text):
    codec, counter, byte_library, word_library = tools
    ids = codec.encode(text)
    assert ids == byte_library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == byte_library.decode(ids, skip_special_tokens=False)
    assert counter.count([text])[0] == len(word_library.encode(text, add_special_tokens=False).ids)


def twins(size):
    """Two words of a and b whose sums of powers modulo 2^64 agree for every odd base."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return [word, word.translate(str.maketrans("ab", "ba"))]


def test_long_words_that_sums_of_powers_confuse(tools):
    codec, counter, byte_library, word_library = tools
    for size in (16, 1024, 4096):
        pair = twins(size)
        texts = [*pair, " ".join(pair), f"{pair[1]} {pair[0]}"]
        want = [e.ids for e in byte_library.encode_batch(texts, add_special_tokens=False)]
        assert encode_all(codec, texts) == want and [codec.decode(i) for i in want] == texts
        assert counter.count(texts).tolist() == [len(e.ids) for e in word_library.encode_batch(texts, add_special_tokens=False)]
        column = pa.array(pair)
        one, two = shingles.word_hashes(column)
        assert one[0] != two[0]
        data = [np.frombuffer(f"{w} {'x y z ' * 20}".encode(), np.uint8) for w in pair]
        assert {d for c in substrings.chunks(data[0], 24) for d in c[-1][:1]}.isdisjoint(d for c in substrings.chunks(data[1], 24) for d in c[-1][:1])


def test_small_blocks_and_small_memo_change_nothing(tools, monkeypatch):
    codec, counter, *_ = tools
    want, counts = encode_all(codec, ODD), counter.count(ODD).tolist()
    monkeypatch.setattr(pieces.packed, "__defaults__", (16,))
    for module in (bpe, token_counts):
        monkeypatch.setattr(module, "MEMO", 64)
    assert encode_all(bpe.ByteCodec("byte_bpe_50k.json"), ODD[:4] + ODD[8:]) == want[:4] + want[8:]
    assert token_counts.TokenCounter("word_bpe_49k.json").count(ODD[8:]).tolist() == counts[8:]


def test_lookahead_bounds_every_dependence():
    """Random small merge lists: tokens that end a lookahead before a cut are those of the whole text."""
    rng = random.Random(3)
    for _ in range(60):
        have, merges = list("ab"), []
        for _ in range(rng.randint(2, 14)):
            pair = rng.choice(have), rng.choice(have)
            if pair not in merges and "".join(pair) not in have:
                merges.append(pair)
                have.append("".join(pair))
        reach = bpe.sufficient_lookahead(merges)

        def encode(text, merges=merges):
            tokens = list(text)
            for left, right in merges:
                k = 0
                while k < len(tokens) - 1:
                    if (tokens[k], tokens[k + 1]) == (left, right):
                        tokens[k : k + 2] = [left + right]
                    k += 1
            return tokens

        for _ in range(30):
            text = "".join(rng.choice("ab") for _ in range(60))
            whole, part = encode(text), encode(text[:40])
            at = 0
            for w, p in zip(whole, part, strict=False):
                if at + len(p) + reach > 40:
                    break
                assert w == p
                at += len(p)


def test_decoder_holds_back_unfinished_characters(tools):
    codec, _, library, _ = tools
    text = "🙂é中퟿" * 20
    ids = codec.encode(text)
    decoder = bpe.TextDecoder(codec.table)
    assert "".join([decoder.feed([i]) for i in ids]) + decoder.finish() == text
    assert codec.decode(ids[1:]) == library.decode(ids[1:], skip_special_tokens=False)


def test_frames(spark, tools):
    _, _, byte_library, word_library = tools
    rows = [(1, "The cat's <|endoftext|> hat", "x"), (1, "The cat's <|endoftext|> hat", "x"), (2, None, None), (None, "É", "y"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode_documents(docs).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text, _ in rows:
        ids = byte_library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(byte_library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    counted = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_documents(docs, limit=5).collect()}
    assert counted == {(i, len((t or "").encode()), n := len(word_library.encode(t or "", add_special_tokens=False).ids), n > 5) for i, t, _ in rows}
    empty = docs.limit(0)
    assert bpe.encode_documents(empty).count() == 0 and token_counts.count_documents(empty).count() == 0
