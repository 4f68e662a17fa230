"""Runs of words against all stretches and periods tried one by one."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import periodic


def plain_runs(x):
    found = {}
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 3))
def test_runs_equal_brute_force(x, times):
    x = x * times + x[: len(x) // 2]
    assert periodic.runs(x) == plain_runs(x)
    words = [b"w%d" % k for k in x]
    assert periodic.text_runs(words) == plain_runs(x)


def test_structured_words():
    fibonacci, morse = [0], [0]
    for a, b in [([0], [0, 1])]:
        for _ in range(9):
            a, b = b, b + a
        fibonacci = b
    while len(morse) < 300:
        morse += [1 - k for k in morse]
    shapes = [[1] * 500, [1, 2] * 100, [1, 2, 3] * 40 + [9] + [1, 2, 3] * 40, fibonacci, morse, morse * 4, ([1] * 7 + [2]) * 9, [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3 + [1]]
    for x in shapes:
        assert periodic.runs(x) == plain_runs(x)
        assert periodic.text_runs([b"%d" % k for k in x]) == plain_runs(x)


def test_masked_words_are_in_no_run():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.randrange(5) for _ in range(40)] + [rng.randrange(50) for _ in range(200)]
        rng.shuffle(x)
        x[60:60] = [7, 8, 9] * rng.randint(2, 6)
        inside = set()
        for a, b in periodic.segments(np.array(x)):
            inside |= set(range(a, b))
        for s, n, _ in plain_runs(x):
            assert set(range(s, s + n)) <= inside


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["a", "A", "é", "b-c", "\x00", "𝒳", "x" * 3000, *(f"w{k}" for k in range(60))]
    rows = [(k, rng.choice([" ", "\n", "\t \r"]).join(rng.choices(vocabulary, k=rng.randint(0, 150)))) for k in range(250)]
    rows += [(None, "la " * 9), (300, None), (301, ""), (302, " \n"), (303, "ha " * 4000), (304, "a b " * 7), (5, "x y " * 20), (5, "x y " * 20), (306, "one two three four five six " * 30)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, runs string, _row int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.query(spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key((i, *plain(i, t))) for i, t in rows)
    assert sum(r.n_runs > 0 for r in got) > 15
    assert periodic.report(docs.limit(0)).count() == 0
    cut = periodic.collapse_runs(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    by = {r.doc_id: r.text for r in cut.collect()}
    assert by[303] == "ha" and by[301] == "" and by[300] is None and by[302] == " \n" and by[306] == "one two three four five six"
    assert sorted((r.start, r.length, r.period) for r in periodic.find_runs(docs).where("doc_id = 5").collect()) == [(0, 40, 2)] * 2
