"""Folders, vocabularies, annotations, exports, streams and the catalogue."""

import json
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera import streaming
from tessera.operators import actions
from tessera.plans import catalog
from tessera.sources import files


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + bytes(5)


def test_folder(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(png(30, 20))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + bytes(6))
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 5, 6))
    (tmp_path / "d.bmp").write_bytes(b"no image")
    (tmp_path / "a.txt").write_text("é, tag")
    (tmp_path / "bad.TXT").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "other.csv").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.png").write_bytes(png(1, 1))
    folder = str(tmp_path)
    assert {(r.file, r.stem, r.ext) for r in files.images(spark, folder).collect()} == {("a.PNG", "a", ".png"), ("b.jpg", "b", ".jpg"), ("c.gif", "c", ".gif"), ("d.bmp", "d", ".bmp")}
    sizes = {r.image: (r.width, r.height, bool(r.error)) for r in files.with_size(files.image_contents(spark, folder)).collect()}
    assert sizes == {"a.PNG": (30, 20, False), "b.jpg": (9, 7, False), "c.gif": (5, 6, False), "d.bmp": (None, None, True)}
    assert {(r.stem, r.text) for r in files.captions(spark, folder).collect()} == {("a", "é, tag"), ("bad", "")}
    assert {(r.stem, r.text, r.error) for r in files.captions(spark, folder, lenient=False).collect()} == {("a", "é, tag", None), ("bad", None, "not UTF-8")}
    uploads = spark.createDataFrame([("u.png", "/u.png"), ("u.exe", "/u.exe")], "file string, path string")
    assert files.mixed(files.images(spark, folder), uploads).where("path IS NULL").count() == 1
    with pytest.raises(ValueError, match="neither"):
        files.mixed(None, None)


def test_vocabularies(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    two = {"idx_to_tag": {"0": "a", "1": "b"}, "tag_to_category": {"a": "General"}}
    want = {(0, "a", "general"), (1, "b", "general")}
    got = lambda p: {tuple(r) for r in files.vocabulary(spark, p).collect()}
    assert got(put("a.json", two)) == want and got(put("c.json", {"dataset_info": {"tag_mapping": two}})) == want
    assert got(put("b.json", {"0": {"tag": "a", "category": "Character"}, "2": {"tag": None}})) == {(0, "a", "character")}
    with pytest.raises(ValueError, match="not a vocabulary"):
        files.vocabulary(spark, put("d.json", {"x": 1}))
    assert [tuple(r) for r in files.class_list(spark, put("l.json", ["p", "q"])).collect()] == [(0, "p"), (1, "q")]
    (tmp_path / "t.csv").write_text('tag,alias\na,"x,y"\na,"z"\nb,\n,q\nc,"""w"",v"\n')
    assert {tuple(r) for r in files.dictionary(spark, str(tmp_path / "t.csv")).collect()} == {("a", "z"), ("c", "w")}


def test_annotations_and_reports(spark, tmp_path):
    shapes = [("a.jpg", 10, 20, "x", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), ("a.jpg", 10, 20, "y", [[0.0, 0.0], [2.0, 0.0]])]
    made = actions.annotation_json(spark.createDataFrame(shapes, "image string, width int, height int, label string, points array<array<double>>")).first()
    (tmp_path / "a.json").write_text(made.json)
    back = files.annotations(spark, str(tmp_path / "a.json")).collect()
    assert [(r.image, r.width, r.height, r.label, r.group_id) for r in back] == [("a.jpg", 10, 20, "x", 1)]
    assert json.loads(made.json)["shapes"][1]["label"] == "y" and json.loads(made.json)["imageData"] is None
    parts = [("i", 4, 5, "eye", 1, 0.5, True, 3, "i_eye.png"), ("i", 4, 5, "hand", 0, 0.0, False, 0, None)]
    report = actions.report_json(spark.createDataFrame(parts, "image string, width int, height int, part string, count int, confidence double, has_detection boolean, mask_pixels long, mask_file string")).first()
    (tmp_path / "r.json").write_text(report.json)
    long = files.mask_reports(spark, str(tmp_path / "r.json"))
    assert long.count() == 2 and [tuple(r) for r in files.render_parts(long).collect()] == [("i", "eye", "i_eye.png")]
    assert files.render_parts(long, ["hand"]).count() == 0
    assert files.alias_parts(["a", "b", "A"], {"A": "a"}) == ["a", "b"]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ny"), ("b", "é")], "stem string, text string")
    actions.export_texts(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.txt").read_bytes() == b"x\ny" and len(list((tmp_path / "out").iterdir())) == 2
    with pytest.raises(FileExistsError):
        actions.export_texts(rows, str(tmp_path / "out"))
    one = spark.createDataFrame([(b"ab",)], "c binary").select(actions.from_data_url(F.concat(F.lit("data:image/png;base64,"), actions.png_base64(F.col("c")))))
    assert bytes(one.first()[0]) == b"ab"


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp_ntz'2024-01-01 05:00:00', 'a' UNION ALL SELECT timestamp_ntz'2024-01-01 00:20:00', 'a'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.events(spark, str(tmp_path / "in"), "ts timestamp_ntz, event_type string")
    streaming.run_once(streaming.windowed_counts(stream), "w", "append", str(tmp_path / "c1"))
    assert [(str(r.start), r.n) for r in spark.table("w").collect()] == [("2024-01-01 00:00:00", 2)]
    captions = streaming.tag_counts(stream.select(F.concat("event_type", F.lit(", X y")).alias("text")))
    streaming.run_once(captions, "t", "complete", str(tmp_path / "c2"))
    assert {tuple(r) for r in spark.table("t").collect()} == {("a", 3), ("x_y", 3)}


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    """Every registered query with SQL, on the smallest tables, by the multiset of its rows."""
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = sorted(c[0] for c in found.description)
    at = {c[0]: k for k, c in enumerate(found.description)}
    want = sorted(str([r[at[n]] for n in names]) for r in found.fetchall())
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(str([r[n] for n in names]) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_empty_files_are_listed(spark, tmp_path):
    for name, body in (("a b+c%20é.txt", b"x"), ("e f+%20é.txt", b""), ("g.TXT", b""), ("h.png", b"")):
        (tmp_path / name).write_bytes(body)
    folder = f"file://{tmp_path}"
    assert {r.file: (r.stem, r.text, r.error) for r in files.captions(spark, folder).collect()} == {
        "a b+c%20é.txt": ("a b+c%20é", "x", None), "e f+%20é.txt": ("e f+%20é", "", None), "g.TXT": ("g", "", None),
    }
    assert [(r.file, r.length) for r in files.images(spark, folder).collect()] == [("h.png", 0)]
    assert [r.error is None for r in files.with_size(files.image_contents(spark, folder)).collect()] == [False]


def test_a_folder_is_listed_without_a_call_for_each_name(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    names = ["a b.txt", "é,+%.txt", "full.txt"]
    for name in names:
        (tmp_path / name).write_text("x" * (name == "full.txt"), "utf-8")
    monkeypatch.setattr(DataFrame, "inputFiles", lambda self: pytest.fail("a call for each name"))
    assert {r.file: r.text for r in files.captions(spark, f"file://{tmp_path}").collect()} == dict(zip(names, ["", "", "x"]))


def test_the_driver_holds_no_index_of_a_folder(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    from tessera.operators import exports

    made = {f"{k} é+%.txt": b"x" * k for k in range(40)} | {"a.txt": b"one tag, A cat is sitting here on the mat.", "a.png": b"p", "b.JPG": b"", "_x.txt": b"h", ".y.txt": b"h", "_k=v.txt": b"", "z.txt._COPYING_": b"h", "n.md": b"m"}
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "sub.txt").mkdir()
    folder = f"file://{tmp_path}/"
    texts = {k: v.decode() for k, v in made.items() if k.endswith(".txt") and k not in ("_x.txt", ".y.txt")}
    monkeypatch.setattr(DataFrameReader, "format", lambda self, kind: pytest.fail(kind))  # such a reader's index holds every name
    monkeypatch.setattr(files, "NAMES_AT_ONCE", 7, raising=False)
    monkeypatch.setattr(files, "BYTES_AT_ONCE", 50, raising=False)
    assert {r.file: r.text for r in files.captions(spark, folder).collect()} == texts
    assert {(r.path, r.file, r.length) for r in files.images(spark, folder).collect()} == {(f"{folder}a.png", "a.png", 1), (f"{folder}b.JPG", "b.JPG", 0)}
    assert {(r.file, bytes(r.content)) for r in files.image_contents(spark, folder).collect()} == {("a.png", b"p"), ("b.JPG", b"")}
    plan = {(r.target, r.file, r.source) for r in exports.split_plan(spark, folder).where("file LIKE 'a.%'").collect()}
    assert plan == {(t, f, s) for t in ("tag", "caption") for f, s in (("a.txt", None), ("a.png", f"{folder}a.png"))}
    with pytest.raises(FileNotFoundError):
        files.captions(spark, f"{folder}none")
