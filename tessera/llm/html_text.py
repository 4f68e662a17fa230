"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text; blocks under the same path of block-level tags share their
statistics: text length, punctuation and number of blocks. Length and punctuation a block are
fused, smoothed over the blocks' order, and paths below a share of the score that half of the
text reaches are dropped, as are blocks of links. Headings stay with what follows them and inside
the element that holds most of the content. Dropped before are blocks under elements whose name,
role, class or id marks them as not the article; a class or id that only begins like such a mark
does not count where it holds more than half of the page's text, and none counts on the elements
that hold the page or the article. Being inside an element that marks an article only adds a part
of the threshold to a block's score.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import read_table

#: Share of the typical score from which a path is content.
THRESHOLD = 0.2
#: Share of the threshold that is added to the score of blocks inside an article element.
MARKED = 0.75
#: Weights of a block's neighbours, nearest first.
SMOOTHING = (0.25, 0.1)
#: Share of a block's text inside links from which it is a menu.
LINKED = 0.6

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var".split()
)
OUTSIDE = frozenset(
    "nav header footer aside form button select option dialog menu svg math canvas audio video object applet head "
    "fieldset datalist".split()
)
ARTICLE = frozenset("article main".split())
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner masthead nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side-bar aside widget widgets footer header comment comments "
    "disqus replies respond reply cookie cookies consent notice notices gdpr newsletter subscribe subscription signup "
    "login share sharing social related recommended popup modal overlay toolbar pagination pager skip-link".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A new element of the key closes an open one of the value, up to the nearest list or table.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table thead tbody tfoot select html body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।؟،]")
_HEADING = re.compile(r"h[1-6]\Z")


#: Elements that hold a page or its article, whatever their class or id.
HOLDERS = frozenset("html body main article".split())


class Block:
    """A run of text: its tag path's number, the tag it is in, and that element's number."""

    __slots__ = ("path", "tag", "text", "linked", "outside", "doubt", "inside", "element")

    def __init__(self, path: int, tag: str, text: str, linked: int, outside: bool, doubt: int, inside: int, element: int):
        self.path, self.tag, self.text, self.linked = path, tag, text, linked
        self.outside, self.doubt, self.inside, self.element = outside, doubt, inside, element


class Page:
    """Blocks in order; elements by number in the order they open, with their parent and last descendant; doubted elements."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parents, self.ends = [0], [0]
        self.doubts = [0]  # the doubted element around each doubted one

    def within(self, element: int, around: int) -> bool:
        return around <= element <= self.ends[around]

    def open_blocks(self) -> list[Block]:
        """The blocks that no mark takes out; a doubted mark is overruled by more than half of the text."""
        found = [b for b in self.blocks if not b.outside]
        size, total = [0] * len(self.doubts), 0
        for b in found:
            own = max(0, len(b.text) - b.linked)
            size[b.doubt], total = size[b.doubt] + own, total + own
        out = [False] * len(size)
        for k in range(len(size) - 1, 0, -1):
            size[self.doubts[k]] += size[k]
        for k in range(1, len(size)):
            out[k] = out[self.doubts[k]] or 2 * size[k] <= total
        return [b for b in found if not out[b.doubt]]


def _marked(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is not part of the article, and whether that is in doubt; a header inside one is part of it."""
    if name in OUTSIDE and not (in_article and name == "header"):
        return True, False
    doubt = False
    for key, a, b, c in _MARKS.findall(attributes) if "=" in attributes and name not in HOLDERS else ():
        value = (a or b or c).lower()
        if key.lower() == "role":
            if value.strip() in OUTSIDE_ROLES:
                return True, False
            continue
        words = [w for w in value.split() if not (in_article and w == "header")]
        if any(w in OUTSIDE_NAMES for w in words):
            return True, False
        doubt |= any(w.split("-")[0].split("_")[0] in OUTSIDE_NAMES for w in words)
    return False, doubt


def parse(page: str) -> Page:
    """The page's blocks; unclosed and misnested tags are borne. Time grows with the page, not with its depth."""
    found = Page()
    paths: dict[tuple[int, str], int] = {}
    # Open elements: name, path, outside, doubted element, article element around or 0, own number.
    stack: list[tuple[str, int, bool, int, int, int]] = [("", 0, False, 0, 0, 0)]
    opened: dict[str, int] = defaultdict(int)
    pieces: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                tag, path, outside, doubt, inside, own = stack[-1]
                found.blocks.append(Block(path, tag, text, linked, outside, doubt, inside, own))
        linked = 0

    def shut(names) -> None:
        """Closes elements down to the last open one of these names."""
        while stack[-1][0] not in names:
            drop()
        drop()

    def drop() -> None:
        name, *_, own = stack.pop()
        opened[name] -= 1
        found.ends[own] = len(found.parents) - 1

    while at < n:
        token = _TOKEN.search(page, at)
        if not token:
            pieces.append(page[at:])
            break
        if token.start() > at:
            raw = page[at : token.start()]
            pieces.append(raw)
            if in_link:
                linked += len(raw.strip())
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(token[1] or token[4]), token[3] or token[6] or ""
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{re.escape(name)}\s*+[^>]*+>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        if name == "br" or name == "wbr":
            pieces.append(" " if name == "br" else "")
            continue
        if name in VOID and name != "hr":
            continue
        flush()
        in_link = 0
        if closing:
            if opened[name]:
                shut((name,))
            continue
        if name in CLOSES_P and opened["p"]:
            shut(("p",))
        if any(opened[x] for x in SIBLINGS.get(name, ())):
            near = next(e[0] for e in reversed(stack) if e[0] in SIBLINGS[name] or e[0] in SCOPES)
            while near in SIBLINGS[name]:
                shut((near,))
                near = next((e[0] for e in reversed(stack) if e[0] in SIBLINGS[name] or e[0] in SCOPES), "")
        if name == "body" and opened["head"]:
            shut(("head",))
        if name == "hr" or attributes.rstrip().endswith("/") and name not in CLOSES_P:
            continue
        _, path, outside, doubt, inside, parent = stack[-1]
        own = len(found.parents)
        found.parents.append(parent)
        found.ends.append(own)
        is_outside, is_doubted = _marked(name, attributes, bool(inside))
        if is_doubted and not outside and not is_outside:
            found.doubts.append(doubt)
            doubt = len(found.doubts) - 1
        path = paths.setdefault((path, name), len(paths) + 1)
        stack.append((name, path, outside or is_outside, doubt, inside or (own if name in ARTICLE else 0), own))
        opened[name] += 1
    flush()
    while len(stack) > 1:
        drop()
    found.ends[0] = len(found.parents) - 1
    return found


def _typical(open_blocks: list[Block], score: dict[int, float]) -> float:
    """The score that blocks with half of the text outside links reach, which one long block cannot raise alone."""
    size: dict[int, int] = defaultdict(int)
    for b in open_blocks:
        size[b.path] += max(0, len(b.text) - b.linked) if b.linked <= LINKED * len(b.text) else 0
    left = sum(size.values()) / 2
    for path in sorted(score, key=score.__getitem__, reverse=True):
        left -= size[path]
        if left <= 0 and size[path]:
            return score[path]
    return max(score.values())


def _container(page: Page, content: list[Block]) -> int:
    """The innermost element around others with more than half of the content's text; headings in it are content. 0 if there is none."""
    size = [0] * len(page.parents)
    for b in content:
        size[page.parents[b.element]] += len(b.text)
    half = sum(len(b.text) for b in content) / 2
    for e in range(len(size) - 1, 0, -1):
        if size[e] > half:
            return e
        size[page.parents[e]] += size[e]
    return 0


def extract(page: str) -> str:
    """Text of the page's content blocks, joined by line ends; empty if there are none."""
    parsed = parse(page)
    open_blocks = parsed.open_blocks()
    if not open_blocks:
        return ""
    total: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for b in open_blocks:
        t = total[b.path]
        t[0] += len(b.text) - min(b.linked, len(b.text))
        t[1] += len(_PUNCTUATION.findall(b.text))
        t[2] += 1
    fused = {p: t[0] / t[2] * (1 + t[1] / t[2]) for p, t in total.items()}
    own = [fused[b.path] for b in open_blocks]
    smooth: dict[int, list[float]] = defaultdict(list)
    for k, b in enumerate(open_blocks):
        s, w = own[k], 1.0
        for d, weight in enumerate(SMOOTHING, 1):
            for j in (k - d, k + d):
                if 0 <= j < len(own):
                    s, w = s + weight * own[j], w + weight
        smooth[b.path].append(s / w)
    score = {p: sum(v) / len(v) for p, v in smooth.items()}
    least = THRESHOLD * _typical(open_blocks, score)
    enough = []
    for b in open_blocks:
        ratio = score[b.path]
        if b.inside:
            ratio += MARKED * least
        enough.append(ratio >= least and b.linked <= LINKED * len(b.text))
    around = _container(parsed, [b for b, is_enough in zip(open_blocks, enough, strict=True) if is_enough])
    follows = False
    for k in range(len(open_blocks) - 1, -1, -1):
        b = open_blocks[k]
        if not _HEADING.match(b.tag):
            follows = enough[k]
        elif b.linked <= LINKED * len(b.text):
            enough[k] |= follows or around > 0 and parsed.within(b.element, around)
    return "\n".join(b.text for b, is_enough in zip(open_blocks, enough, strict=True) if is_enough)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page, from its whole html.

    One row for each row. Null or empty html, and pages without an article, give the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
