"""The pipeline's stages on a small corpus, and the registered names."""

import random

import __spark_entry__
import corpus_pipeline
from tessera.llm import catalog


def test_names():
    assert {n.split("_")[0] for n in catalog.QUERIES} >= {f"op{k}" for k in (1, 2, 4, 6, 7, 8, 9, 10)}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(60, 120))), "en", f"s{i % 4}", 1))
    near = rows[5][1].split()
    near[10] = "other"
    rows += [(200, rows[3][1].upper(), "en", "s1", 1), (201, " ".join(near), "en", "s0", 1), (202, "short", "en", "s0", 1), (203, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = [r.doc_id for r in now.select("doc_id").collect()]
    assert set(seen["quality_rules"]) == set(range(120)) | {200, 201}
    assert set(seen["exact_dedup"]) == set(range(120)) - {3} | {200, 201}
    assert set(seen["ngram_jaccard"]) == set(range(120)) - {3} | {200}
    assert set(seen["mix_sources"]) <= set(seen["ngram_jaccard"])
    assert sorted(seen["bpe_round_trip"]) == sorted(seen["mix_sources"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen["bpe_round_trip"])


def test_odd_tables(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(60, 90)))
    long = " ".join(rng.choices([f"v{k}" for k in range(20_000)], k=30_000))
    twin = text()
    rows = [(i, text(), None if i % 5 == 0 else "a") for i in range(40)]
    rows += [(None, text(), "a"), (50, None, "a"), (51, "", "b"), (52, long, "b"), (53, twin, "b"), (53, twin, "b"), (54, text(), None), (54, text(), None)]
    names = ["_row", "_key", "_digest", "_document", "_nth", "document", "_h", "chunk"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    for name, folder, table in (("odd", "odd", docs), ("empty", "none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        now = spark.read.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES:
            before, now = now, function(spark, now, f"{tmp_path}/{folder}")
            now.write.parquet(f"{tmp_path}/{folder}/{stage}")
            now = spark.read.parquet(f"{tmp_path}/{folder}/{stage}")
            if stage == "bpe_round_trip":
                assert now.count() == before.count()
                continue
            assert now.columns == docs.columns
            got = sorted((str(r.doc_id), r.text[:20]) for r in now.collect())
            if name == "empty":
                assert got == []
            elif stage == "quality_rules":
                assert [g[0] for g in got] == sorted([str(i) for i in range(40)] + ["None", "52", "53", "53", "54", "54"])
            elif stage in ("exact_dedup", "ngram_jaccard"):
                assert [g[0] for g in got] == sorted([str(i) for i in range(40)] + ["None", "52", "53", "54", "54"])
