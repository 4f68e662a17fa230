"""Text expressions and caption heuristics on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import captions, text


@pytest.fixture
def value(spark):
    def run(make, *rows, kind="string"):
        frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, c {kind}")
        return [r[0] for r in frame.orderBy("k").select(make(F.col("c"))).collect()]

    return run


def test_strip_tokens_and_tags(value):
    assert value(text.strip, "  a\t b 　\n", "", " ") == ["a\t b", "", ""]
    assert value(text.tokens, "", ",", " a ,A,, b ", "x\t,\ty") == [[], [], ["a", "b"], ["x", "y"]]
    assert value(text.normal_tag, "Long Hair", "long_hair", " a  b ") == ["long_hair", "long_hair", "a__b"]
    assert value(text.keyword_list, "a,A\nb,,b\r\nC") == [["a", "b", "C"]]
    assert value(text.fixed_tags, "a,\nb,,a", None) == [["a", "b", "a"], []]
    assert value(text.truthy, " Yes ", "ON", "0", None, "checked") == [True, True, False, False, True]


def test_append_and_insert(value, spark):
    got = spark.range(1).select(text.append_missing(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()[0]
    assert got == ["a", "a", "b"]
    insert = lambda c: text.insert_tags(c, ["Long Hair", "x"])
    rows = ["a, long_hair", "a, LONG HAIR, X", "a\r\n\r\ncap, long", "", "a\n\n"]
    want = ["x, a, long_hair", None, "Long Hair, x, a\n\ncap, long", "Long Hair, x", "Long Hair, x, a"]
    assert value(insert, *rows) == want
    assert value(lambda c: text.insert_tags(c, ["x"], prepend=False), "a, b\n\nc") == ["a, b, x\n\nc"]
    again = value(insert, *[w for w in want if w])
    assert again == [None] * len(again)


@pytest.mark.parametrize(("before", "include", "want"), [(False, True, "a "), (False, False, "a K.w"), (True, True, " z k.W q"), (True, False, "K.w z k.W q")])
def test_trim(value, before, include, want):
    cut = lambda c: text.trim_at_keyword(c, "k.w", before, include)
    assert value(cut, "a K.w z k.W q", "none kxw", "") == [want, None, None]
    assert value(lambda c: text.trim_at_keyword(c, "k.W", True, False, case=True), "a K.w z k.W q") == ["k.W q"]


def test_keywords_and_refusals(value):
    assert value(lambda c: text.keyword_hits(c, ["B", "a", "x%"]), "AbC", "x% ", "") == [["B", "a"], ["x%"], []]
    rows = ["I cannot, it is against policy", "inappropriate by policy", "our POLICY", "", " \n", "fine", "I can’t"]
    got = value(text.refusal, *rows)
    assert [(r.refused, r.level) for r in got] == [(True, "高"), (True, "中"), (True, "低"), (False, "低"), (False, "低"), (False, "低"), (False, "低")]
    assert [r.patterns for r in got[:3]] == [["i cannot"], ["inappropriate"], ["policy"]]


def test_fences(value):
    rows = ["```xml\n<a/>\n```", "```XML\n<a/>\n```", "```xml\n<a/>", "```xml ```", "plain", ""]
    assert value(text.fence_folder_ok, *rows) == [True, False, False, True, False, False]
    got = value(text.fence_body, *rows)
    assert [tuple(r) for r in got] == [("<a/>", True, True), ("<a/>", True, True), (rows[2], True, False), (rows[3], True, False), ("plain", False, False), ("", False, False)]


def test_names(value, spark):
    names = ["img10", "img2", "007", "7", "a2", "2a", "A2", ""]
    keyed = spark.createDataFrame([(n,) for n in names], "c string")
    got = [r[0] for r in keyed.orderBy(text.natural_key(F.col("c")), "c").collect()]
    assert got == ["", "2a", "007", "7", "A2", "a2", "img2", "img10"]
    assert value(text.extension, "a.b.JPG", ".hidden", "none", "x.") == [".JPG", "", "", "."]
    assert value(text.stem, "a.b.JPG", ".hidden", "none") == ["a.b", ".hidden", "none"]
    assert value(text.post_id, "danbooru_12.jpg", "__Danbooru-34.png", "1234567_p0.png", "12345_p0.png", "x.png") == ["12", "34", "1234567", None, None]
    assert value(text.unescape, r"a\"b\'c\nd\te") == ["a\"b'c\nd\te"]


def test_assembly(spark):
    none = F.array().cast("array<string>")
    xml = text.tags_xml(F.array(F.lit("a<b"), F.lit("c")), none, F.lit(None).cast("array<string>"), F.array(F.lit("z")))
    line = text.tag_text(F.lit("safe"), F.lit(""), none, F.array(F.lit("ip")), F.array(F.lit("g")))
    assert tuple(spark.range(1).select(xml, line).first()) == ("<tags>\n  <general>a<b, c</general>\n  <artist>z</artist>\n</tags>", "safe, ip, g")


def test_chat_text(value):
    rows = [
        '{"choices":[{"message":{"content":"hi"}}]}',
        '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"image"},{"text":"b"}]}}]}',
        '{"choices":[{"text":"t"}],"text":"u"}',
        '{"content":[{"type":"text","text":"c"},{"type":"x","text":"d"}]}',
        '{"message":{"content":"m"}}',
        '{"other":1}',
    ]
    assert value(text.chat_text, *rows) == ["hi", "a\nb", "t", "c", "m", '{"other":1}']


SPLITS = [
    ("", ("", "", "empty")),
    ("a, b\nCaption : x y", ("a, b", "x y", "explicit_prefix")),
    ("1girl, smile, A woman walks along the long river bank. Calm.", ("1girl, smile", "A woman walks along the long river bank. Calm.", "boundary_split")),
    ("1girl, A woman walks on by.", ("1girl, A woman walks on by.", "", "tags_only")),
    ("red, one two three four five six seven The cat sits here on the mat now. End", ("red", "one two three four five six seven The cat sits here on the mat now. End", "boundary_split")),
    ("red, one two three four five six The cat sits here on the mat now. End", ("red, one two three four five six", "The cat sits here on the mat now. End", "boundary_split")),
    ("a, b\n\nlow words end.", ("a, b", "low words end.", "newline_split")),
    ("a, b\n\nc", ("a, b c", "", "tags_only")),
    ("标签，一个女孩站在河边看着远方的山和天空中的云朵。", ("标签", "一个女孩站在河边看着远方的山和天空中的云朵。", "boundary_split")),
    ("标签一个女孩。", ("标签一个女孩。", "", "tags_only")),
    ("tag one, The day one two three four five six seven eight is nine", ("tag one", "The day one two three four five six seven eight is nine", "boundary_split")),
]


def test_split(value):
    got = value(captions.split_caption, *[r for r, _ in SPLITS], None, "  \n")
    assert [(r.tags_text.rstrip("，"), r.caption_text, r.mode) for r in got] == [w for _, w in SPLITS] + [("", "", "empty")] * 2
    assert got[-3].confidence == "medium" and got[2].confidence == "high" and got[3].warnings == [captions.TAGS_ONLY_WARNING]


def test_normal_format(value):
    rows = [
        "a, b, one two three four five six",
        "a, one two three four Big day in town",
        "a, one two three four Big day in",
        "a, one two three Four five six seven, rest",
        "a, b",
        "a caption: x",
        "a, b\n\nOne two three four five six",
        None,
    ]
    want = ["a, b\n\none two three four five six", "a, one two three four\n\nBig day in town", "a\n\none two three four Big day in", "a, one two three\n\nFour five six seven, rest", None, "a\n\ncaption: x", "a\n\nb One two three four five six", None]
    got = value(captions.normal_format, *rows)
    assert got[:6] == want[:6] and got[7] is None


def test_any_text_splits(value):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aB ,.\n:捕。，", k=rng.randint(0, 30))) + rng.choice(["", "caption:", " The "]) for _ in range(400)]
    got = value(captions.split_caption, *texts)
    assert all(r.mode and r.confidence and r.tags_text is not None and r.caption_text is not None for r in got)
    assert len(value(captions.normal_format, *texts)) == 400


def test_plain_tags_trim_spaces_only(value, spark):
    parts = lambda c: text.comma_list(c, plain=True)
    assert value(parts, " a ,\nb\t,  , 　c ,d \n") == [["a", "\nb\t", "c", "d \n"]]
    assert value(lambda c: text.normal_tag(c, plain=True), " Long Hair", "ΑΣ", "İx", "\n A") == ["long_hair", "ασ", "ix", "\n_a"]
    put = lambda c: text.insert_tags(c, ["x", "A b"], plain=True)
    assert value(put, "a,\nb", "X,\na_b", "a_b\r\n\r\nc", "x , a B\n\nc", None) == ["x, A b, a, \nb", "A b, X, \na_b", "x, A b, a_b\r\n\r\nc", None, None]


@pytest.mark.parametrize("query", ["insert_tags", "tag_index", "tag_inventory"])
def test_tag_queries_agree_with_sql_on_odd_texts(spark, tmp_path, query):
    import duckdb

    from tessera.plans import catalog

    texts = ["a,\nb, The", "\tA ,b ,the", "Extra Tag,\r\nthe\n\nrest, of", "ΑΣ, İx", "the, extra_tag", "a\rb, c \n", "", None, " ,\n,"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(catalog.ORACLE_SQL[query]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES[query](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
