"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tessera.llm import spelling
from tessera.llm.shared import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, str(form.get(w)), root(w), n[w], len(near[w]), str(n[form[w]] if w in form else None)) for w in n)


def test_query_equals_all_pairs(spark, tmp_path):
    rng = random.Random(12)
    stems = ["".join(rng.choices("abcdeéÉÿ×", k=rng.randint(6, 9))) for _ in range(25)]
    words = []
    for s in stems:
        words += [s] * 400
        for _ in range(8):
            k, c = rng.randrange(len(s) + 1), rng.choice("abzé")
            v = rng.choice([s[:k] + c + s[k:], s[:k] + c + s[k + 1 :], s[:k] + s[k + 1 :]])
            words += [v] * rng.choice([1, 2, 30])
            words += [v[:3] + "q" + v[3:]] * rng.choice([1, 2, 3])
    rng.shuffle(words)
    rows = [(k, rng.choice([" ", ", ", "1"]).join(w if rng.random() < 0.8 else w.upper() for w in words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40)]
    rows += [(None, "another ANOTHER another"), (5000, None), (5001, ""), (5002, "aaaaaaa " * 6000), (5003, "short 123 中文 " * 9), (5004, "x" * 9000 + " " + "x" * 9000), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in spelling.query(spark, str(tmp_path)).collect())
    want = plain(rows)
    assert got == want
    assert any(r[1] != "None" and r[2] != r[1] for r in want), "no chain of forms"
    forms = spark.createDataFrame([("another", "other")], "word string, root string")
    assert [tuple(r) for r in spelling.normalised(spark, docs, forms).collect()] == [(None, "another", "other", 3)]


def test_dense_words(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(500)} | {"À" * 7, "À" * 8, "ÿ" * 8, "a" * 8 + "ÿ"})
    rows = spark.createDataFrame([(w, k + 2) for k, w in enumerate(words)], "word string, n bigint")
    got = [(r.a, r.b) for r in spelling.near_pairs(spark, rows, Scratch(spark, "t")).collect()]
    assert len(got) == len(set(got))
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert spelling.variants(spark, rows.limit(0)).count() == 0
