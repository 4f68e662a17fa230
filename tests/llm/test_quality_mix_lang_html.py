"""Quality rules, mixing, language identification and page text against plain versions."""

import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import xxhash

from tessera.llm import html_text, langid, mixing, quality


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "c", "h") for i, t, s in rows], "doc_id bigint, text string, source string, _h string, bucket string")


# Quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


PIECE = re.compile(r"[^\W_]+|[^\w\x20\x09-\x0D]+|_")
h64 = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)


def grams(text):
    h = [h64(p.encode()) for p in PIECE.findall(text or "")]
    two = [h64(b.to_bytes(8, "little"), h64(a.to_bytes(8, "little"))) for a, b in zip(h, h[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(x) % (1 << quality.BITS) for x in h + two]


def test_quality_against_plain_version(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    rows = [(i, " ".join(word() + rng.choice(["", ",", ".", "!!"]) for _ in range(rng.randint(0, 130))), "s") for i in range(40)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "a b c " * 400, "s"), (103, "x y\nx y\n \n\nx y", "s"), (104, "# | <> " * 60, "s"), (105, "a b c a b c d", None), (3, rows[3][1], "s")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i < 20 else 0, 0) for i in range(40)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.judge(spark, docs, labels).collect()
    raw, good = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)
    for i, t, _ in rows:
        for b in grams(t):
            raw[b] += 1
            good[b] += i < 20
    s = quality.SMOOTHING
    weights = np.log((good * raw.sum() / good.sum() + s) / (raw + s))
    by = {}
    for i, t, _ in rows:
        by[i] = t
    assert len(got) == len(rows)
    for r in got:
        want = base(by[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        g = grams(by[r.doc_id])
        llr = float(np.mean([weights[b] for b in g])) if g else 0.0
        assert math.isclose(r.llr, llr, abs_tol=1e-6)
        assert r.kept == (not want[-1] and llr >= quality.THRESHOLD)
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(spark, docs.limit(0), labels.limit(0)).count() == 0
    assert all(r.llr == 0 for r in quality.judge(spark, docs, labels.limit(0)).collect())


def test_verdicts_do_not_change_with_the_size_of_the_table(spark):
    docs = spark.createDataFrame([(k, f"some words {k} " * 40 if k % 3 else "zq zx zv zw " * 40 + str(k)) for k in range(300)], "doc_id bigint, text string")
    labels = docs.where("doc_id % 3 > 0").selectExpr("doc_id", "1 AS quality")
    few = {r.doc_id: r.kept for r in quality.judge(spark, docs, labels).collect()}
    many = docs.unionByName(docs.selectExpr("doc_id + 1000 AS doc_id", "text")).unionByName(docs.selectExpr("doc_id + 2000 AS doc_id", "text"))
    assert {r.doc_id: r.kept for r in quality.judge(spark, many, labels).collect() if r.doc_id < 1000} == few


# Mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(spark):
    rng = random.Random(2)
    names = ["b", "a", None, "É", "c", "tiny", "wordless"]
    rows = []
    for i in range(900):
        s = "b" if i % 3 == 0 else rng.choice(names)
        n = 0 if s == "wordless" else rng.choice([1, 5, 30]) if s == "tiny" else rng.randint(0, 300)
        rows.append((i, " ".join(["w"] * n) if n or rng.random() < 0.5 else None, s))
    rows.append((5000, "w " * 20_000, "a"))
    rows += rows[:2]
    docs = docs_of(spark, rows)
    got = mixing.mix(spark, docs, fan_in=32).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    target, taken = plain_targets(size), {}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        share = target[r.source] / max(size[r.source], 1)
        assert math.floor(share + 1e-12) <= r.copies <= math.ceil(share - 1e-9) or r.size == 0
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.005 * t, 2)
    again = mixing.mix(spark, docs.repartition(7), fan_in=32).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
    drawn = mixing.draw(spark, docs)
    assert drawn.columns == docs.columns
    assert drawn.count() == mixing.mix(spark, docs).groupBy().sum("copies").first()[0]
    assert mixing.mix(spark, docs.limit(0)).count() == 0 and mixing.draw(spark, docs.limit(0)).count() == 0


def test_long_documents_keep_sums_and_expectations():
    import pandas as pd

    sizes, p, total = [200, 90, 7], 0.3, 1000
    rows = pd.DataFrame({"size": sizes, "doc_id": [1, 2, 3], "order": [0, 0, 0], "source_size": total, "fraction": p})
    mean, pool = np.zeros(3), 0.0
    for seed in range(3000):
        got = mixing._settle_long(seed)(("s",), rows.copy())
        q, rest = got["fraction"].to_numpy(), got["pool"].iloc[0]
        assert set(q) <= {0.0, 1.0} and 0 <= rest <= 1
        assert math.isclose((q * sizes).sum() + rest * (total - sum(sizes)), p * total, rel_tol=1e-9) or rest in (0, 1)
        mean, pool = mean + q / 3000, pool + rest / 3000
    assert np.allclose(mean, p, atol=0.04) and abs(pool - p) < 0.04


def test_pivotal_keeps_sums_and_expectations():
    rng = np.random.default_rng(3)
    sizes, p = np.array([3.0, 50, 7, 7, 1, 20]), np.array([0.2, 0.5, 0.9, 0.1, 0.5, 1.0])
    mean = np.zeros(6)
    for _ in range(4000):
        q, left = mixing.pivotal(sizes, p, rng.random(6))
        assert all(x in (0, 1) for k, x in enumerate(q) if k != left)
        assert math.isclose((sizes * q).sum(), (sizes * p).sum(), rel_tol=1e-9)
        mean += q / 4000
    assert np.allclose(mean, p, atol=0.04)


# Languages


def test_language_identification(spark):
    rng = random.Random(4)
    make = {"en": ["th", "ing", "er", "ou"], "de": ["sch", "ei", "ung", "ü"], "fr": ["eau", "é", "ment", "ou"], "es": ["ción", "ñ", "os", "ue"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(make))
        text = " ".join("".join(rng.choices(make[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(10, 60)))
        rows.append((i, text, lang))
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, rows[0][1], None), (None, rows[1][1], rows[1][2]), (904, "thing " * 300_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumnRenamed("none", "x")
    got = langid.identify(spark, docs, langid.fit(docs)).collect()
    truth = {i: lang for i, _, lang in rows}
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[904].lang_pred == "en" and by[903].lang_pred == by[0].lang_pred
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(spark, docs.limit(3), None).collect()} == {"und"}
    one = docs.where("lang = 'fr'")
    assert {r.lang_pred for r in langid.identify(spark, one, langid.fit(one)).collect()} == {"fr"}


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    rows, langs = [], 140
    for k in range(langs):
        parts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)]
        rows += [(40 * k + i, " ".join("".join(rng.choices(parts, k=2)) for _ in range(30)), f"l{k:03}") for i in range(16 if k < 100 else 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert sorted(n for f in model.families for n in f) == sorted({r[2] for r in rows})
    truth = {i: lang for i, _, lang in rows}
    got = langid.identify(spark, docs, model).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(rows)


def test_the_sample_is_bounded_by_documents(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda parts: " ".join(rng.choices(parts, k=12))
    en, de = ["thing", "other", "house"], ["schön", "leicht", "übung"]
    # One id in all rows of a language, one row many times over, and one of two ids whose rows all fall on one side.
    one, two, *more = [k for k in range(90) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(one, text(en), "en", 1) for _ in range(900)] + [(two, "leicht schön", "de", 1)] * 900 + [(k, text(de), "de", 1) for k in more]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key int")
    monkeypatch.setattr(langid, "FIT_ROWS", 32)
    got = langid.sample(docs).collect()
    assert {r.lang for r in got} == {"en", "de"} and all(sum(r.lang == x for r in got) <= 16 for x in ("en", "de"))
    assert len({r.text for r in got if r.lang == "de"}) > 4
    answer = langid.identify(spark, docs, langid.fit(docs)).collect()
    assert len(answer) == len(rows) and all(r.lang_pred == ("en" if r.doc_id == one else "de") for r in answer)


def test_decisions_against_plain_version(spark):
    rng = random.Random(8)
    parts = {f"l{k}": ["".join(rng.choices("abcdefghijkéü", k=3)) for _ in range(5)] for k in range(6)}
    make = lambda lang: " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randint(1, 30)))
    rows = [(k, make(f"l{k % 6}"), f"l{k % 6}") for k in range(300)] + [(400, "½ ² ① 12", "l0"), (401, "Abc!Déf", None), (402, "x" * 70_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(spark, docs, model).collect()}
    assert got[400].lang_pred == "und" and got[400].score == 0
    of = np.concatenate([[b if b >= 128 or chr(b).isalpha() else 32] for b in range(256)])
    for i, text, _ in rows:
        if i == 400:
            continue
        b = [int(of[x]) for x in f" {text.lower()} ".encode()]
        buckets = [((((x << 16) | (y << 8) | z) * 2654435761) & 0xFFFFFFFF) >> 19 for x, y, z in zip(b, b[1:], b[2:], strict=False)]
        margin = [sum(model.weights[k, m] for k in buckets) / len(buckets) + model.bias[m] for m in range(len(model.bias))]
        chance = [1 / (1 + math.exp(-4 * m)) for m in margin]
        count = len(model.families)
        f = max(range(count), key=lambda k: margin[k])
        names, at = model.families[f], count + sum(len(p) for p in model.pairs[:f])
        votes, belief = [0] * len(names), [0.0] * len(names)
        for k, (x, y) in enumerate(model.pairs[f]):
            votes[x if chance[at + k] >= 0.5 else y] += 1
            belief[x], belief[y] = belief[x] + chance[at + k], belief[y] + 1 - chance[at + k]
        best = max(range(len(names)), key=lambda k: (votes[k], belief[k], names[k]))
        score = chance[f] * (belief[best] / (len(names) - 1) if len(names) > 1 else 1)
        assert got[i].lang_pred == names[best] and math.isclose(got[i].score, score, rel_tol=1e-4)


# Pages

ARTICLE = """<h1>The  title</h1><p>First&nbsp;paragraph, with <a href="/x">a link</a> &amp; more words, to be long.
</p><p><b>Second one.<br><p>Third paragraph, unclosed; it goes on &#8212; and on.<blockquote>Quoted.</blockquote><ul><li>one<li>two</ul>"""
WANT = "The title\nFirst paragraph, with a link & more words, to be long.\nSecond one.\nThird paragraph, unclosed; it goes on — and on.\nQuoted.\none\ntwo"
AROUND = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-banner">We use cookies.</div>
<!-- <p>hidden</p> --><div class="ad">Buy now, it is cheap, really cheap, today.</div>{}<aside>Side text, of some length.</aside>
<form>Subscribe <input value="x>y"><button>Go</button></form><section class="comments"><p>Nice post, thank you, I liked it.</p></section>
<footer>&copy; 2024</footer>"""


def test_page_text_with_and_without_a_marked_article():
    assert html_text.extract(AROUND.replace("{}", f"<article>{ARTICLE}</article>") + "</body></html>") == WANT
    assert html_text.extract(AROUND.replace("{}", f"<article>{ARTICLE}")).startswith(WANT)
    plain = html_text.extract(AROUND.replace("{}", f'<div class="content">{ARTICLE}</div>'))
    assert plain.split("\n")[:4] == WANT.split("\n")[:4] and "cookies" not in plain and "Nice post" not in plain


SENTENCE = "A sentence of the text, which is about fifty long. "


def test_page_text_beside_a_long_quotation():
    paragraphs = [f"Paragraph {k}. {SENTENCE * 3}".strip() for k in range(10)]
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    for inner in (f"<blockquote><p>{SENTENCE * 12}</p></blockquote>", f"<ul><li>{SENTENCE * 12}</li></ul>", f"<table><tr><td>{SENTENCE * 12}</td></tr></table>"):
        got = html_text.extract(f"<div><h1>Title</h1>{body}{inner}</div>").split("\n")
        assert got == ["Title", *paragraphs, (SENTENCE * 12).strip()]


def test_page_text_outside_the_mark():
    paragraphs = [f"Paragraph {k}. {SENTENCE * 3}".strip() for k in range(10)]
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    cards = "".join(f'<article><h3><a href="/{k}">Teaser number {k}</a></h3></article>' for k in range(4))
    assert html_text.extract(f"<div>{body}</div>{cards}").split("\n") == paragraphs
    part = html_text.extract(f"<main><p>{paragraphs[0]}</p></main><div>{body}</div>").split("\n")
    assert part == [paragraphs[0], *paragraphs]
    short = html_text.extract(f"<article>{body}</article><article><p>{SENTENCE * 2}</p></article>").split("\n")
    assert short == [*paragraphs, (SENTENCE * 2).strip()]
    links = "".join(f'<li><a href="/{k}">Another page of the site, {k}</a></li>' for k in range(5))
    assert html_text.extract(f"<article>{body}<ul>{links}</ul></article>").split("\n") == paragraphs


def test_page_text_with_long_attributes():
    long = "<b>x</b> " * 1000
    page = f"<div data-a=\"{long}\" data-b='{long}' class=\"sidebar\"><p>{SENTENCE}</p></div><div data-a='{long}'><p>{SENTENCE * 2}</p></div>"
    assert html_text.extract(page) == (SENTENCE * 2).strip()
    assert html_text.extract(f"<p>{SENTENCE}</p><p data-a=\"{long}") .startswith(SENTENCE.strip())


def test_page_text_of_odd_pages(spark):
    odd = ["", None, "   ", "no tags at all", "<p", "<p>a<p>b", "<!-- open", "<script>never closed", "<a href='x>y\">z", "<p>" * 5000 + "deep", "<article></article>", "&lt;p&gt; &bogus; &#x41;"]
    rows = [(k, f"u{k}", h, "x") for k, h in enumerate(odd)] + [(None, None, "<p>a", "x"), (1, "u1", None, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_text.extract_pages(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[0] == by[2] == by[6] == by[7] == by[10] == "" and by[3] == "no tags at all" and by[5] == "a\nb" and by[11] == "<p> &bogus; A"
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_page_text_under_names_that_begin_like_marks():
    body = "".join(f"<p>Paragraph {k}. {SENTENCE * 3}</p>" for k in range(6))
    want = html_text.extract(f"<body>{body}</body>")
    assert want.count("\n") == 5
    for tag in ("html", "body", "main", "article", "div"):
        for name in ("sidebar-right", "header-fixed", "ad-free", "share-enabled", "login-user"):
            assert html_text.extract(f'<{tag} class="{name}">{body}</{tag}>') == want
    for tag in ("html", "body", "main", "article"):
        assert html_text.extract(f'<{tag} class="sidebar">{body}</{tag}>') == want
    assert html_text.extract(f'<div>{body}</div><div class="ad-box"><p>{SENTENCE * 3}</p></div>') == want
    assert html_text.extract(f'<div>{body}</div><div id="comments"><p>{SENTENCE * 90}</p></div>') == want
    assert html_text.extract(f'<article>{body}<p><a href="/x">Click</a></p></article>') == want


def test_page_text_of_deep_pages():
    import time

    def spent(depth):
        page = "<div>" * depth + f"<p>{SENTENCE}</p><h2>Head</h2>" + "</div><p>x</p>" * depth
        at = time.perf_counter()
        assert SENTENCE.strip() in html_text.extract(page)
        return time.perf_counter() - at

    spent(2000)
    assert spent(40_000) < 60 * max(spent(4000), 0.01)


class Plain(HTMLParser):
    """Blocks of well-formed pages with their paths, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.names, self.blocks, self.run, self.linked, self.link = [], [], "", 0, False

    def end(self):
        text = " ".join(self.run.split())
        if text:
            self.blocks.append((tuple(n for n, _ in self.names), text, self.linked, any(o for _, o in self.names), any(n == "article" for n, _ in self.names)))
        self.run, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        self.end()
        self.names.append((tag, tag in ("nav", "footer") or dict(attrs).get("class") == "sidebar"))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
            return
        self.end()
        self.names.pop()

    def handle_data(self, data):
        self.run += data
        self.linked += len(data.strip()) if self.link else 0


def plain_text(page):
    parser = Plain()
    parser.feed(page)
    parser.end()
    found = [b for b in parser.blocks if not b[3]]
    if not found:
        return ""
    marks = lambda t: len(re.findall(r"[.,;:!?]", t))
    fused = {}
    for path in {b[0] for b in found}:
        own = [b for b in found if b[0] == path]
        length, points = sum(len(b[1]) - min(b[2], len(b[1])) for b in own) / len(own), sum(marks(b[1]) for b in own) / len(own)
        fused[path] = length * (1 + points)
    line = [fused[b[0]] for b in found]
    near = {0: 1.0, 1: html_text.SMOOTHING[0], 2: html_text.SMOOTHING[1]}
    smooth = []
    for k in range(len(line)):
        js = [j for j in range(k - 2, k + 3) if 0 <= j < len(line)]
        smooth.append(sum(near[abs(j - k)] * line[j] for j in js) / sum(near[abs(j - k)] for j in js))
    score = {p: sum(s for b, s in zip(found, smooth, strict=True) if b[0] == p) / sum(b[0] == p for b in found) for p in fused}
    linked = lambda b: b[2] > html_text.LINKED * len(b[1])
    plain = {p: sum(len(b[1]) - b[2] for b in found if b[0] == p and not linked(b)) for p in fused}
    half, typical = sum(plain.values()) / 2, max(score.values())
    for p in sorted(score, key=score.__getitem__, reverse=True):
        half -= plain[p]
        if half <= 0 and plain[p]:
            typical = score[p]
            break
    least = html_text.THRESHOLD * typical
    return "\n".join(b[1] for b in found if not linked(b) and score[b[0]] + (html_text.MARKED * least if b[4] else 0) >= least)


def test_page_text_against_plain_version():
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 8))) + rng.choice(["", "", ",", "."]) for _ in range(n))

    def tree(depth):
        out = ""
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.5 or depth > 4:
                tag = rng.choice(["p", "pre", "blockquote"])
                text = f'<a href="/x">{words(rng.randint(1, 6))}</a>' if rng.random() < 0.2 else words(rng.randint(1, 60))
                out += f"<{tag}>{text}</{tag}>\n"
            elif kind < 0.6:
                out += rng.choice(['<nav><div>{}</div></nav>', '<div class="sidebar"><p>{}</p></div>', "<footer><p>{}</p></footer>"]).format(words(9))
            else:
                tag = rng.choice(["div", "section", "article", "div"])
                out += f"<{tag}>{tree(depth + 1)}</{tag}>"
        return out

    some = 0
    for _ in range(200):
        page = f"<html><body>{tree(0)}</body></html>"
        want = plain_text(page)
        some += "\n" in want
        assert html_text.extract(page) == want
    assert some > 100
