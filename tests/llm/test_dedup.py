"""Exact dedup, n-gram join and components against brute force."""

import hashlib
import random
import re
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components, exact_dedup, ngram_join, shared, shingles
from tessera.llm.shared import Scratch, listed, shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, _row string, digest string, class_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "d", "c") for i, t in rows], SCHEMA)


def test_exact_report(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200_000), (2, "a B"), (None, "a b")]
    got = exact_dedup.dedup_report(spark, frame(spark, rows)).collect()
    by = {}
    for i, t in rows:
        by.setdefault((t or "").translate(LOWER), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        norm = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (max(i for i in by[norm] if i is not None), len(by[norm]))
    assert sorted((r.doc_id for r in got if r.kept), key=str) == [2, 3, 4, 6, 7]
    assert exact_dedup.dedup_report(spark, frame(spark, rows).limit(0)).count() == 0


def test_index_persists_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=3)
    first = {r.doc_id: r.kept for r in index.add(frame(spark, [(1, "a"), (2, "b")])).collect()}
    second = {r.doc_id: (r.keep_id, r.kept) for r in index.add(frame(spark, [(3, "A"), (4, "c"), (5, "C")])).collect()}
    assert first == {1: True, 2: True}
    assert second == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert index.rows().count() == 3
    assert exact_dedup.DigestIndex(spark, index.table).buckets == 3
    index.compact()
    assert index.rows().count() == 3 and index.add(frame(spark, [(9, "C")])).first().keep_id == 5


def test_an_index_is_found_by_its_files(spark):
    name = f"t_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, name, buckets=3)
    index.add(frame(spark, [(1, "a"), (2, "b")]))
    assert index.folder.startswith(shared_dir(spark))
    spark.sql(f"DROP TABLE {name}")  # as in a new session, which knows no table
    again = exact_dedup.DigestIndex(spark, name)
    assert again.buckets == 3 and {r.doc_id: r.kept for r in again.add(frame(spark, [(3, "A"), (4, "c")])).collect()} == {3: False, 4: True}
    again.compact()
    # As if a call had been stopped after it emptied the index, and another batch had come.
    whole = exact_dedup.DigestIndex(spark, f"{name}_whole", buckets=3)
    whole._write(again.rows(), whole.table)
    again.drop()
    again = exact_dedup.DigestIndex(spark, name, buckets=3)
    again.add(frame(spark, [(5, "d")]))
    again.compact()
    assert again.rows().count() == 4 and again.add(frame(spark, [(9, "C")])).first().keep_id == 4
    again.drop()
    assert not [n for n in listed(spark, index.folder) if n.startswith(name)]


def test_scratch_tables_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(shared, "_ROOTS", set())
    before = set(listed(spark, shared_dir(spark)))
    exact_dedup.dedup_report(spark, frame(spark, [(1, "a"), (2, "A")])).collect()
    assert set(listed(spark, shared_dir(spark))) - before - {"digest-index"}
    shared.clear_scratch(spark)
    assert set(listed(spark, shared_dir(spark))) - {"digest-index"} == before - {"digest-index"}


def test_a_fold_that_fails_leaves_no_table(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=3)
    before = listed(spark, index.folder)
    monkeypatch.setattr(index, "_settled", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(frame(spark, [(1, "a")]))
    assert listed(spark, index.folder) == before


def test_a_batch_handed_in_again_gets_the_same_answer(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=3)
    index.add(frame(spark, [(1, "a")]), batch="one")
    two = frame(spark, [(2, "A"), (3, "b"), (4, "b")])
    got = [sorted((r.doc_id, r.keep_id, r.kept) for r in index.add(two, batch="two").collect()) for _ in range(2)]
    assert got[0] == got[1] == [(2, 1, False), (3, 4, False), (4, 4, True)]
    assert index.rows().count() == 2


def test_the_index_decides_rows_of_later_batches(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i if i % 9 else None, f"t{rng.randint(0, 40)}") for i in range(1, 121)]
    for batches in (1, 2, 5):
        monkeypatch.setattr(exact_dedup, "BATCHES", batches)
        got = exact_dedup.dedup_report(spark, frame(spark, rows)).collect()
        best, size = {}, {}
        for i, t in rows:
            best[t], size[t] = max(best.get(t, -1), -1 if i is None else i), size.get(t, 0) + 1
        of = {hashlib.sha256(t.encode()).hexdigest(): t for t in best}
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(best)
        assert all((r.keep_id, r.group_size) == (max(best[of[r.text_sha256]], 0) or None, size[of[r.text_sha256]]) for r in got)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_drop_duplicates_keeps_columns(spark):
    rows = [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (None, "c"), (4, None), (5, "")]
    docs = frame(spark, rows)
    kept = exact_dedup.drop_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "A"), (3, "b"), (None, "c"), (5, "")], key=str)


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, num, den):
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = {i: sets_of(t, width) for i, t in rows}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    line = "the very common line of many texts"
    out = []
    base = [rng.choices(words, k=rng.randint(1, 120)) for _ in range(8)]
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text += line.split()
        out.append((i * 7 % 101, " ".join(text)))
    return out + [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "x " * 30_000)]


@pytest.mark.parametrize(("width", "num", "seed"), [(3, 90, 1), (5, 80, 2), (2, 50, 3)])
def test_join_finds_the_components(spark, width, num, seed):
    rows = corpus(seed)
    got = ngram_join.components(spark, frame(spark, rows + rows[:3]), width, num, 100, bits=14).collect()
    want = brute(rows, width, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows) + 3


def test_join_links_within_a_group_beside_its_lead(spark):
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(40)]
        middle, last = [*base[:19], "m", *base[20:]], [*base[:-1], "l"]
        rows += [(100 * g, " ".join(middle)), (100 * g + 1, " ".join(base)), (100 * g + 2, " ".join(last))]
        # What differs is frequent elsewhere, so the three have the same prefix, which no other text has.
        for k in range(6):
            own = [f"g{g}x{k}y{j}" for j in range(120)]
            rows.append((100 * g + 10 + k, " ".join([*own[:60], *base[16:24], *own[60:], *middle[16:24], "z", *base[-4:], "z", *last[-4:]])))
    want = brute(rows, 3, 90, 100)
    assert all(want[100 * g][1] == 100 * g and want[100 * g + 2][1] == 100 * g + 1 for g in range(4))
    got = ngram_join.components(spark, frame(spark, rows), 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_one_of_each(spark):
    rows = corpus(4)
    docs = frame(spark, rows)
    kept = ngram_join.one_of_each(spark, docs)
    want = {c for _, c in brute(rows, 5, 80, 100).values()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert ngram_join.one_of_each(spark, docs.limit(0)).count() == 0
    # Two texts under one id: the one that is a near copy goes, the other stays.
    a, b = [" ".join(f"{x}{k}" for k in range(40)) for x in "ab"]
    got = ngram_join.one_of_each(spark, frame(spark, [(1, a), (5, a + " end"), (5, b), (5, b)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (5, b), (5, b)]
    assert ngram_join.one_of_each(spark, frame(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).count() == 2


def test_word_hashes_follow_words(monkeypatch):
    texts = ["A b  c", None, "", "x\ty\x0bz ", "É é", "w" * 70 + " a b"]
    monkeypatch.setattr(shingles, "BLOCK", 20)
    got = list(shingles.word_hashes(pa.array(texts).slice(1)))
    monkeypatch.undo()
    want = list(shingles.word_hashes(pa.array(texts)))
    assert all(np.array_equal(a, b) for a, b in zip(got, want[1:], strict=True))
    assert [len(w) for w in want] == [3, 0, 0, 3, 2, 3]
    assert want[0][1] == want[5][2] and want[4][0] != want[4][1]


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(components, "PLAIN_ROWS", few)
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    links += [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(45)]
    got = {r.node: r.component for r in components.connected(spark, spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "t").collect()}
    label = {}
    for a, b in links:
        for x in (a, b):
            label.setdefault(x, x)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    single = {i for i in label if all(i in (a, b) and a == b or i not in (a, b) for a, b in links)}
    assert got == {i: root(i) for i in label if i not in single}
