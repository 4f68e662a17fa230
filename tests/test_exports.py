"""Exports that are stopped, repeated and reviewed, and settings in layers."""

import pytest

from tessera.operators import exports, settings, written


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "set"
    made.mkdir()
    texts = {"a": "one tag, two tag, A cat is sitting here on the mat.", "b": "one tag, two tag", "c": "caption: A cat is here.", "d": "", "e x+y": "é tag, other tag"}
    for name, text in texts.items():
        (made / f"{name}.txt").write_text(text, "utf-8")
    (made / "a.png").write_bytes(b"picture a")
    (made / "a.jpg").write_bytes(b"another a")
    (made / "c.WEBP").write_bytes(b"")
    (made / "z.png").write_bytes(b"no caption")
    return made


def paths(folder):
    return {"tag": f"file://{folder}-tag", "caption": f"file://{folder}-caption"}


def content(folder, target):
    return {p.name: p.read_bytes().decode() for p in folder.parent.glob(f"set-{target}/*")}


def test_split_export(spark, folder, tmp_path):
    source, manifest = f"file://{folder}", f"file://{tmp_path}/manifest"
    plan = exports.split_plan(spark, source)
    first = exports.carry_out(spark, plan, paths(folder), manifest).collect()
    assert {r.state for r in first} == {"written"}
    tags = {"a.txt": "one tag, two tag", "b.txt": "one tag, two tag", "e x+y.txt": "é tag, other tag"}
    image = next(r.file for r in first if r.file.startswith("a.") and r.file != "a.txt")
    assert content(folder, "tag") == tags | {image: (folder / image).read_text()}
    assert content(folder, "caption") == {"a.txt": "A cat is sitting here on the mat.", "c.txt": "A cat is here.", "c.WEBP": "", image: (folder / image).read_text()}
    # One file is lost, one changed: the manifest says so, and a repeated export mends just these.
    (tmp_path / "set-tag" / "b.txt").unlink()
    (tmp_path / "set-caption" / "c.txt").write_text("other")
    assert sorted(map(tuple, exports.differing(spark, manifest, paths(folder)).collect())) == [("caption", "c.txt", "changed"), ("tag", "b.txt", "missing")]
    again = {(r.target, r.file): r.state for r in exports.carry_out(spark, plan, paths(folder), manifest).collect()}
    assert {k for k, v in again.items() if v == "written"} == {("tag", "b.txt"), ("caption", "c.txt")} and len(again) == len(first)
    assert exports.differing(spark, manifest, paths(folder)).count() == 0
    assert not list(tmp_path.glob("set-*/*.part"))


def test_a_stopped_export_goes_on(spark, folder, tmp_path, monkeypatch):
    plan = exports.split_plan(spark, f"file://{folder}")
    exports.carry_out(spark, plan.where("target = 'tag'"), paths(folder), f"file://{tmp_path}/part")
    states = {r.target: r.state for r in exports.carry_out(spark, plan, paths(folder), f"file://{tmp_path}/all").collect()}
    assert states == {"tag": "kept", "caption": "written"}


def test_reviewed_rewrites(spark, folder):
    source = f"file://{folder}"
    review = exports.rewrites(spark, source).collect()
    assert [(r.file, r.text) for r in review] == [("a.txt", "one tag, two tag")]
    plan = spark.createDataFrame(review + [("b.txt", "0" * 32, "other")], "file string, old_md5 string, text string")
    assert {r.file: r.state for r in exports.rewrite(plan, source).collect()} == {"a.txt": "rewritten", "b.txt": "changed"}
    assert (folder / "a.txt").read_text() == "one tag, two tag" and (folder / "b.txt").read_text() == "one tag, two tag"
    assert {r.file: r.state for r in exports.rewrite(plan, source).collect()} == {"a.txt": "kept", "b.txt": "changed"}
    assert exports.rewrites(spark, source).count() == 0


def test_layers(spark):
    kind = "name string, value string"
    layers = [spark.createDataFrame(r, kind) for r in ([("a", "1"), ("b", None)], [("a", "2"), ("b", "3"), ("b", "4")], [("c", "5"), ("d", None)])]
    assert sorted(map(tuple, settings.layered(layers).collect())) == [("a", "1", 0), ("b", "3", 1), ("c", "5", 2)]


def test_part_settings(spark):
    registry = spark.createDataFrame([("face", "box", True, 0.4), ("hand", "box", False, 0.3)], "part string, type string, enabled boolean, conf double")
    options = spark.createDataFrame([("enabled_parts.hand", "Yes"), ("enabled_parts.face", None), ("confidence.face", "0.6"), ("confidence.hand", "much"), ("confidence.other", "1"), ("x", "y")], "name string, value string")
    requests = spark.createDataFrame([(1, None, None), (2, ["faces", "nose"], {"hand": 0.9}), (3, [], {})], "request int, parts array<string>, confidence map<string, double>")
    got = {(r.request, r.part): (r.enabled, r.conf, r.enabled_by, r.conf_by) for r in settings.part_settings(requests, options, registry, {"faces": "face"}).collect()}
    assert got == {
        (1, "face"): (True, 0.6, "default", "file"), (1, "hand"): (True, 0.3, "file", "default"),
        (2, "face"): (True, 0.6, "request", "file"), (2, "hand"): (False, 0.9, "request", "request"),
        (3, "face"): (False, 0.6, "request", "file"), (3, "hand"): (False, 0.3, "request", "default"),
    }
    plain = settings.part_settings(requests.where("request = 1"), options.limit(0), registry).collect()
    assert {(r.part, r.enabled, r.conf) for r in plain} == {("face", True, 0.4), ("hand", False, 0.3)}


def test_written_tables_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(written, "_ROOTS", set())
    table = written.Written(spark, "clear")
    assert table.save(spark.range(3), "rows").count() == 3
    assert written.has_files(spark, table.root)
    written.clear_written(spark)
    assert not written.has_files(spark, table.root)
