"""Text, tag and caption expressions (Column -> Column), all inside Catalyst but ``xml_root``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

SPACE = r"\s"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without the white space, of all of Unicode, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_spaces(c: Column) -> Column:
    """Without the space characters, of all of Unicode, at both ends; tabs and line ends stay."""
    return F.regexp_replace(c, r"\A\p{Zs}+|\p{Zs}+\z", "")


def lower_each(c: Column) -> Column:
    """Each letter in lower case by itself, whatever stands beside it."""
    return F.lower(F.translate(c, "\u0130\u03a3", "i\u03c3"))


def strip_commas(c: Column) -> Column:
    return F.regexp_replace(c, r"^,+|,+$", "")


def line_ends(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def one_line(c: Column) -> Column:
    """White space collapsed to single spaces."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def present(c: Column) -> Column:
    """A row for each value that is not null. A filter would compute the value a second time."""
    return F.explode(F.array_compact(F.array(c)))


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# Lists of tags and keywords


def comma_list(c: Column, plain: bool = False) -> Column:
    """Trimmed, non-blank parts between commas, in order; ``plain`` trims spaces only."""
    return F.filter(F.transform(F.split(c, ","), strip_spaces if plain else strip), lambda t: t != "")


def tokens(c: Column) -> Column:
    """The set of lower-cased, trimmed parts between commas."""
    return F.array_distinct(comma_list(F.lower(c)))


def normal_tag(c: Column, plain: bool = False) -> Column:
    """Trimmed, lower case, spaces as underscores; ``plain`` trims spaces only and lower-cases letter by letter, as SQL does."""
    return F.replace(lower_each(strip_spaces(c)) if plain else F.lower(strip(c)), F.lit(" "), F.lit("_"))


def first_distinct(items: Column, key) -> Column:
    """Items whose key no earlier item has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def keyword_list(c: Column) -> Column:
    """Keywords between commas and line ends, without case-insensitive repeats."""
    return first_distinct(comma_list(F.translate(c, "\r\n", ",,")), F.lower)


def fixed_tags(c: Column) -> Column:
    """Tags between commas and line feeds, repeats kept."""
    return comma_list(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(",")))


def append_missing(tags: Column, extra: Column) -> Column:
    """``tags`` and then those of ``extra`` that are not among them, each once; exact spelling."""
    return F.concat(tags, F.array_except(extra, tags))


def insert_tags(c: Column, new: Sequence[str], prepend: bool = True, plain: bool = False) -> Column:
    """The caption text with tags put into its first paragraph; null if all are there already.

    Spellings that differ in case, or in space and underscore, are the same tag. ``plain`` takes line
    ends as they are and tags as ``normal_tag`` does.
    """

    def put(p: Column) -> Column:
        missing = F.filter(literals(new), lambda t: ~F.array_contains(p["known"], normal_tag(t, plain)))
        return let(missing, lambda m: F.when(F.size(m) > 0, F.concat(F.array_join(F.concat(m, p["have"]) if prepend else F.concat(p["have"], m), ", "), p["rest"])))

    def parted(parts: Column) -> Column:
        rest = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        rest = F.when(rest != "", F.concat(F.lit("\n\n"), rest)).otherwise("").alias("rest")
        return let(comma_list(F.element_at(parts, 1), plain), lambda have: let(F.struct(have.alias("have"), F.transform(have, lambda t: normal_tag(t, plain)).alias("known"), rest), put))

    return let(F.split(c if plain else line_ends(c), "\n\n", 2), parted)


# Keywords and refusals


def keyword_hits(c: Column, keywords: Sequence[str]) -> Column:
    """All keywords that occur, whatever their case, in keyword order."""
    text = F.lower(c)
    return F.filter(literals(keywords), lambda k: F.contains(text, F.lower(k)))


def trim_at_keyword(c: Column, keyword: str, before: bool, include: bool, case: bool = False) -> Column:
    """The text cut at the first occurrence of ``keyword``; null where it doesn't occur.

    ``before`` takes away what precedes it, else what follows; with ``include`` the keyword goes too.
    """
    at = F.locate(keyword, c) if case else F.locate(keyword.lower(), F.lower(c))
    size = len(keyword)
    if before:
        kept = F.substr(c, at + size if include else at)
    else:
        kept = F.left(c, (at - 1 if include else at - 1 + size))
    return F.when(at > 0, kept)


def refusal(
    c: Column,
    high: Sequence[str] = vocab.REFUSAL_HIGH,
    medium: Sequence[str] = vocab.REFUSAL_MEDIUM,
    low: Sequence[str] = vocab.REFUSAL_LOW,
) -> Column:
    """struct(refused, level, patterns): phrases of the highest tier that has any; blank text has none."""
    text = F.lower(c)
    found = [F.filter(literals(tier), lambda p: F.contains(text, p)) for tier in (high, medium, low)]
    patterns = F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(found[2])
    blank = F.coalesce(strip(c) == "", F.lit(True))
    patterns = F.when(blank, literals(())).otherwise(patterns)
    level = (
        F.when(blank, vocab.LEVEL_LOW)
        .when(F.size(found[0]) > 0, vocab.LEVEL_HIGH)
        .when(F.size(found[1]) > 0, vocab.LEVEL_MEDIUM)
        .otherwise(vocab.LEVEL_LOW)
    )
    return F.struct((F.size(patterns) > 0).alias("refused"), level.alias("level"), patterns.alias("patterns"))


# Fences


def fence_folder_ok(c: Column) -> Column:
    """Whether the trimmed text opens with an xml fence, lower case only, and closes with a fence."""
    s = strip(c)
    return F.startswith(s, F.lit("```xml")) & F.endswith(s, F.lit("```"))


def fence_body(c: Column) -> Column:
    """struct(body, has_open, has_close): the text between the fences if both lines are there."""
    s = strip(F.coalesce(c, F.lit("")))
    lines = F.split(line_ends(s), "\n")
    opened = F.startswith(F.lower(strip(F.element_at(lines, 1))), F.lit("```xml"))
    closed = strip(F.element_at(lines, -1)) == "```"
    inner = strip(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
    body = F.when(opened & closed & (F.size(lines) >= 2), inner).otherwise(s)
    return F.struct(body.alias("body"), opened.alias("has_open"), closed.alias("has_close"))


#: Characters of a preview.
PREVIEW = 500


def preview(c: Column, characters: int = PREVIEW) -> Column:
    """The beginning of a text, to show."""
    return F.left(c, F.lit(characters))


@F.pandas_udf(T.StringType())
def xml_root(texts: pd.Series) -> pd.Series:
    """The tag of the root of well-formed XML, else null. Spark's own XPath functions fail on what is not well-formed."""
    found: list[str | None] = []
    for xml in texts:
        try:
            found.append(ElementTree.fromstring(xml).tag if xml else None)
        except ElementTree.ParseError:
            found.append(None)
    return pd.Series(found, dtype=object)


# Captions


def is_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike("[一-鿿]"), F.lit(False))


def without_prefix(c: Column) -> Column:
    """Without a leading ``caption:`` of any case."""
    return strip(F.regexp_replace(strip(c), r"(?iU)^caption\s*:\s*", ""))


# Names


def natural_key(c: Column) -> Column:
    """Sorts digit runs as numbers, before letters, and letters whatever their case."""
    runs = F.regexp_extract_all(c, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(
        runs,
        lambda x: F.struct(
            F.when(x.rlike("^[0-9]"), 0).otherwise(1).alias("kind"),
            F.when(x.rlike("^[0-9]"), x.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"),
            F.when(x.rlike("^[0-9]"), "").otherwise(F.lower(x)).alias("letters"),
        ),
    )


def extension(c: Column) -> Column:
    """The last dot and what follows; none for a name that only starts with dots."""
    return F.regexp_extract(c, r"^.*?[^./\\][^/\\]*?(\.[^./\\]*)$", 1)


def stem(c: Column) -> Column:
    return F.left(c, F.char_length(c) - F.char_length(extension(c)))


def post_id(name: Column, patterns: Sequence[str] = vocab.POST_ID_PATTERNS) -> Column:
    """The id in a file name by the first pattern that fits."""
    base = stem(name)
    return F.coalesce(*[F.nullif(F.regexp_extract(base, f"(?i){p}", 1), F.lit("")) for p in patterns])


def truthy(c: Column, words_: Sequence[str] = vocab.TRUE_WORDS) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*words_), F.lit(False))


def unescape(c: Column) -> Column:
    r"""``\"``, ``\'``, ``\n`` and ``\t`` as the characters they name."""
    pairs = (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\t", "\t"))
    return reduce(lambda e, p: F.replace(e, F.lit(p[0]), F.lit(p[1])), pairs, c)


# Assembly


def tags_xml(general: Column, character: Column, copyright_: Column, artist: Column) -> Column:
    """An element for each category that has tags; nothing is escaped."""
    named = (("general", general), ("character", character), ("copyright", copyright_), ("artist", artist))
    lines = [
        F.when(F.size(tags) > 0, F.concat(F.lit(f"  <{name}>"), F.array_join(tags, ", "), F.lit(f"</{name}>")))
        for name, tags in named
    ]
    return F.concat_ws("\n", F.lit("<tags>"), *lines, F.lit("</tags>"))


def tag_text(rating: Column, quality: Column, character: Column, copyright_: Column, general: Column) -> Column:
    """Rating and quality if given, then characters, copyrights and general tags."""
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(literals(()))
    some = lambda c: F.coalesce(c, literals(()))
    return F.array_join(F.concat(one(rating), one(quality), some(character), some(copyright_), some(general)), ", ")


def chat_text(c: Column) -> Column:
    """The text of a chat service's JSON answer, from the first place that holds any; else the answer itself."""
    answer = F.try_parse_json(c)

    def is_text(path: str) -> Column:
        """The value if it is a JSON string."""
        found = F.try_variant_get(answer, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(answer, path, "string"))

    def parts(path: str, typed: bool) -> Column:
        items = F.try_variant_get(answer, path, "array<struct<type:string,text:string>>")
        good = F.filter(items, lambda p: p["text"].isNotNull() & ((p["type"] == "text") if typed else F.lit(True)))
        return F.when(F.size(good) > 0, F.array_join(F.transform(good, lambda p: p["text"]), "\n"))

    return F.coalesce(
        is_text("$.choices[0].message.content"),
        parts("$.choices[0].message.content", False),
        is_text("$.choices[0].content"),
        is_text("$.choices[0].text"),
        parts("$.content", True),
        is_text("$.text"),
        is_text("$.message.content"),
        c,
    )
