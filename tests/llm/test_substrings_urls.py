"""Substring dedup and temporal URL lists against plain versions."""

import random
import re
from datetime import date, timedelta

import numpy as np

from tessera.llm import substrings, url_lists


def cut(text, least=10, block=1 << 18):
    found = list(substrings.chunks(np.frombuffer(text, np.uint8), least, block))
    return [np.concatenate(c).tolist() for c in zip(*found, strict=True)] if found else [[]] * 5


def plain_chunks(text, least):
    """(place, words, begin, bytes) of chunks, word by word."""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    h = []
    for _, e in spans:
        v = 0
        for x in text[max(0, e - 200) : e]:
            v = ((v << 1) + int(substrings._GEAR[x])) & 0xFFFF
        h.append(v)
    r = substrings.REACH
    last = [k for k in range(len(h)) if h[k] == min(h[max(0, k - r) : k + r + 1]) or k == len(h) - 1]
    out = []
    for s in [0, *[k + 1 for k in last]]:
        e = next((k for k in last if k - s + 1 >= least), None)
        if e is not None:
            out.append((s, e - s + 1, spans[s][0], spans[e][1] - spans[s][0]))
    return out


def test_chunks_against_plain_version():
    rng = random.Random(1)
    texts = [" \n".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(n)).encode() for n in (1, 9, 10, 11, 40, 700)]
    texts += [b"a b " * 60, b"x " * 50, b" ", b"", b"a", b"\t\n", b" " + b"x" * 3000 + b" y" * 30, b"q" * 900]
    for text in texts:
        got = cut(text)
        assert list(zip(*got[:4], strict=True)) == plain_chunks(text, 10)
        for block in (30, 100, 1000):
            assert cut(text, block=block) == got


def test_chunks_resist_insertions():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(3000)).encode()
    moved = b"inserted words, " + text[:8000] + b" more " + text[8000:]
    one, two = cut(text), cut(moved)
    assert len(one[0]) > 400 and len(set(one[4])) == len(one[4])
    assert len(set(one[4]) - set(two[4])) <= 12
    words = {d: moved[b : b + n].split() for _, _, b, n, d in zip(*two, strict=True)}
    assert all(words[d] == text[b : b + n].split() for _, _, b, n, d in zip(*one, strict=True) if d in words)


def shared_words(rows, size):
    """For each row, places of words in a gram of ``size`` words that a row of another id or text holds too."""
    held, of = {}, {(i, t): (t or "").split() for i, t in rows}
    for i, w in of.items():
        for k in range(len(w) - size + 1):
            held.setdefault(tuple(w[k : k + size]), set()).add(i)
    return {i: {j for k in range(len(w) - size + 1) if len(held[tuple(w[k : k + size])]) > 1 for j in range(k, k + size)} for i, w in of.items()}


def found_words(rows, got):
    """For each row, places of the words of the passages of its id that lie in it."""
    out = {(i, t): set() for i, t in rows}
    for r in got:
        for i, t in out:
            raw = (t or "").encode()
            if i == r.doc_id and len(raw) >= r.end and len(raw[r.begin : r.end].split()) == r.n_words:
                at = len(raw[: r.begin].split())
                out[i, t] |= set(range(at, at + r.n_words))
    return out


def test_passages_against_word_grams(spark):
    rng = random.Random(6)
    fresh = lambda n, m=4: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=m)) for _ in range(n))
    rows = []
    for k in range(150):
        passage = fresh(51, 1 + k % 6)
        rows += [(2 * k, f"{fresh(30)} {passage} {fresh(30)}"), (2 * k + 1, f"{fresh(45)} {passage} {fresh(9)}")]
    for k, period in enumerate(("a b ", "tick tack tock ", "q r s t ", "x ")):
        rows += [(1000 + 2 * k, f"{fresh(40)} {period * 24}{fresh(40)}"), (1001 + 2 * k, f"{fresh(70)} {period * 24}{fresh(20)}")]
    line, common = fresh(12), fresh(60)
    rows += [(2000 + k, f"{fresh(70)}\n{line}\n{fresh(k)}") for k in range(12)]
    rows += [(3000 + k, f"{fresh(k)} {common} {fresh(9)}") for k in range(12)]
    rows += [(4000, None), (4001, ""), (4002, "a"), (4003, "a"), (4004, rows[0][1]), (None, rows[301][1]), (4005, "é " * 30_000)]
    rows += [(4006, f"{common} {fresh(20)} {common}"), (4007, fresh(40) + " " + " ".join([fresh(55)] * 2)), rows[3]]
    docs = spark.createDataFrame([(*r, "d", "x") for r in rows], "doc_id bigint, text string, digest string, document string")
    got = substrings.passages(spark, docs).collect()
    found, exact, long = found_words(rows, got), shared_words(rows, substrings.LEAST_WORDS), shared_words(rows, 51)
    assert all(found[i] <= exact[i] for i in found)  # every word of a passage is in words that another document holds
    assert all(not long[i] or long[i] & found[i] for i in found)  # none of 51 words is missed
    assert sum(len(long[i] & found[i]) for i in found) >= 0.75 * sum(map(len, long.values()))
    assert all(r.n_words >= substrings.LEAST_WORDS and (r.repeat_words > 0) == (r.doc_id is not None and r.first_doc_id < r.doc_id) for r in got)
    cleaned = {r.doc_id: r.text for r in substrings.without_repeats(spark, docs).collect()}
    text = dict(rows)
    assert set(cleaned) == set(text) and cleaned[0] == text[0] and cleaned[2000] == text[2000] and cleaned[4004].split() == []
    assert len(cleaned[3011].split()) < len(text[3011].split())
    assert substrings.without_repeats(spark, docs).columns == docs.columns
    assert substrings.passages(spark, docs.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))
    passage = fresh(60)
    rows = [(1, f"{fresh(20)} {passage} {fresh(30)}"), (1, f"{fresh(50)} {passage} {fresh(9)}"), (2, f"{fresh(9)} {passage}"), (3, fresh(99))]
    got = substrings.passages(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2]
    places = shared_words(rows, 51)
    assert all(places[r] & found_words(rows, got)[r] for r in rows[:3])


def test_cut_leaves_a_passage_where_it_comes_first(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n))
    a, b = fresh(60), fresh(60)
    rows = [(1, f"{fresh(50)} {a} {fresh(50)}"), (5, f"{fresh(50)} {a} {b} {fresh(50)}"), (9, f"{fresh(50)} {b} {fresh(50)}")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, cut string")
    cut = {r.doc_id: r.text for r in substrings.without_repeats(spark, docs).collect()}
    assert cut[1] == rows[0][1] and set(b.split()) <= set(cut[5].split()) and 0 < len(set(cut[5].split()) & set(a.split())) < 25
    assert len(set(cut[9].split()) & set(b.split())) < 25


def test_temporal_lists(spark):
    rng = random.Random(5)
    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    values = ["a.com", "x.a.com", "b.org", "Y.b.ORG", "com"]
    entries = [(rng.choice(values), rng.choice(["add", "remove", "other"]), day(rng.randint(0, 30)), "z") for _ in range(60)]
    entries += [(None, "add", day(1), "z"), ("a.com", "add", None, "z"), *entries[:5]]
    urls = ["http://a.com/", "https://u:p@X.A.com:80/p?q#f", "http://y.b.org.", "http://com/", "http://c.net/a.com", "not a url", None, ""]
    rows = [(i, rng.choice(urls), day(rng.randint(-2, 33)) if rng.random() < 0.95 else None, "e") for i in range(300)]
    rows += [rows[0], (None, "http://a.com", day(5), "e")]
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetched date, entry string")
    lists = spark.createDataFrame(entries, "value string, action string, day date, entry string")
    got = url_lists.judge(captures, lists).collect()
    assert len(got) == len(rows)

    def active(value, at):
        days = {}
        for v, a, d, _ in entries:
            if v and v.lower() == value and d and d <= at and a != "other":
                days[d] = max(a, days.get(d, ""))
        return bool(days) and days[max(days)] == "add"

    for r in got:
        if not r.host or not r.fetched:
            assert not r.listed and r.entry is None
            continue
        labels = r.host.split(".")
        scopes = [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))]
        want = next((s for s in scopes if active(s, r.fetched)), None)
        assert (r.entry, r.listed) == (want, want is not None)
    assert {r.host for r in got} == {"a.com", "x.a.com", "y.b.org", "com", "c.net", None}
    assert url_lists.judge(captures.limit(0), lists).count() == 0
    assert not any(r.listed for r in url_lists.judge(captures, lists.limit(0)).collect())


def test_addresses_and_odd_hosts(spark):
    urls = ["http://1.2.3.4/", "http://[::1]:80/x", "http://u@[2001:DB8::1]/", "http://a.b.c.:8080/", "http://[::1", "http://3.4.c/"]
    captures = spark.createDataFrame([(k, u, date(2024, 1, 5)) for k, u in enumerate(urls)], "page_id bigint, url string, fetched date")
    entries = ["3.4", "4", "1.2.3.4:80", "[::1]", "https://B.C.:443/x?y", "[2001:db8::1]:8080", "::1", ":80", ""]
    for value, want in zip(entries, [[], [], [0], [1], [3], [2], [], [], []], strict=True):
        lists = spark.createDataFrame([(value, "add", date(2024, 1, 1))], "value string, action string, day date")
        got = url_lists.judge(captures, lists).collect()
        assert sorted(r.page_id for r in got if r.listed) == want, value
    assert [r.host for r in sorted(got, key=lambda r: r.page_id)] == ["1.2.3.4", "[::1]", "[2001:db8::1]", "a.b.c", None, "3.4.c"]
