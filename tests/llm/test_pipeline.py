import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(3000)]
    path, rows = str(tmp_path_factory.mktemp("sf")), []
    for i in range(150):
        rows.append((i, " ".join(rng.choice(words, 80)) + "."))
    for i in range(150, 200):
        rows.append((i, " ".join(f"{w}###" for w in rng.choice(words, 80))))
    passage = " ".join(rng.choice(words, 60))
    for i in range(200, 210):
        rows.append((i, " ".join(rng.choice(words, 80)) + " " + passage + " " + " ".join(rng.choice(words, 80))))
    rows += [(300, rows[0][1]), (301, rows[1][1] + " more"), (302, None), (303, ""), (304, "too short")]
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(150)) | set(range(200, 210))
    assert clean <= set(kept["quality_rules"]) and not set(kept["quality_rules"]) & {302, 303, 304}
    assert clean <= set(kept["quality_classifier"]) and not set(kept["quality_classifier"]) & set(range(150, 200))
    assert set(kept["near_dedup"]) == set(kept["quality_classifier"]) - {300, 301}
    assert set(kept["suffix_dedup"]) == set(kept["near_dedup"])
    before, after = kept["near_dedup"], kept["suffix_dedup"]
    assert after[200] == before[200] and all(len(before[i]) - len(after[i]) > 300 for i in range(201, 210))
    assert all(after[i] == before[i] for i in range(150))


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len({r.doc_id for r in rows}) == 160
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_sample_of_a_common_id_is_bounded(spark):
    """One labelled id in all of many tasks: the driver gets the sample, not a sample from each task."""
    rng, cq = np.random.default_rng(4), corpus_pipeline.compression_quality
    texts = [rng.bytes(1500).hex() for _ in range(1200)]
    rows = [(0, t) for t in texts + texts[:600]] + [(i, f"bad {i}") for i in range(1, 60)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 16), "doc_id long, text string").localCheckpoint()
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(60)], "doc_id long, quality int")
    by_hash = docs.where("doc_id = 0").selectExpr("xxhash64(text) as h", "text").toPandas().sort_values("h")
    wanted = sorted(by_hash["text"][:101])
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")  # 101 texts of 3 kB, but not 16 times as many
    try:
        got = cq.sample(docs, labels, None, 101, 20_000)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert sorted(t.decode() for t, y in got if y == 1) == wanted
    assert sorted(t.decode() for t, y in got if y == 0) == sorted(f"bad {i}" for i in range(1, 60))
