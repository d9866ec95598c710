import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slidefit.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return packing.WordTokens(open(PATH, "rb").read())


def test_ids_are_the_tokenizers(words):
    rng = np.random.default_rng(1)
    alphabet = list("ab 'sTRELD019.,!\n\t  é İΣçñ中😀́\x1c\x85²½ŉſ©")
    texts = ["", " ", "Grüße,\u2028w\x85x\xa0y z\x1fa", "ΣΑΣ. </w> a</w>b", "<|endoftext|>a<|", "né\u0301e e\u0301 \u0301e", "don't STOP'LL 12a34", "<|endoftext|> x <|startoftext|>", "x" * 5000, *["".join(rng.choice(alphabet, 25)) for _ in range(3000)]]
    for t, ids in zip(texts, words.documents([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_wide_vocabularies_and_full_pools(monkeypatch):
    """Ids beyond 16 bits; a pool that is full at every block and grows for a long text."""
    monkeypatch.setattr(packing, "POOL", 100)
    monkeypatch.setattr(packing, "SPARE", 50)
    monkeypatch.setattr(packing, "BLOCK", 200)
    blob = json.loads(open(PATH, "rb").read())
    wide = blob | {"model": blob["model"] | {"vocab": {k: v + 100_000 for k, v in blob["model"]["vocab"].items()}}, "added_tokens": [t | {"id": t["id"] + 100_000} for t in blob["added_tokens"]]}
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcde é12 "), n)) for n in [50, 2000, 20, 0, 300] * 4]
    for b, size in ((blob, 2), (wide, 4)):
        words = packing.WordTokens(json.dumps(b).encode())
        assert words.pool.dtype.itemsize == size
        for t, ids in zip(texts, words.documents([t.encode() for t in texts]), strict=True):
            assert ids.dtype == np.dtype("<u4") and ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids
        next(words.documents([b"a"]))
        assert len(words.pool) <= 150


def test_combinations_fill_the_window():
    c = packing.combinations(30)
    assert (c.sum(1) == 30).all() and len({tuple(r) for r in c.tolist()}) == len(c)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    counts[1:] = rng.integers(0, [3, 50, 1, 2000][seed], 64)
    used = np.zeros(65, np.int64)
    for combo, n in packing.plan(counts):
        assert sum(combo) <= 64 and n > 0
        for q in combo:
            used[q] += n
    np.testing.assert_array_equal(used, counts)
    assert packing.plan(np.zeros(65, np.int64)) == []


def test_nnls_is_near_the_best():
    """Against projected gradient steps on a small problem."""
    rng = np.random.default_rng(5)
    patterns, wanted = packing.combinations(24), np.r_[0, rng.integers(1, 40, 24)].astype(float)
    x = packing.solve_nnls(patterns, wanted)
    a = np.zeros((25, len(patterns)))
    for k in range(3):
        np.add.at(a, (patterns[:, k], np.arange(len(patterns))), 1)
    a[0] = 0
    z, step = np.zeros(len(patterns)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20000):
        z = np.maximum(0, z - step * a.T @ (a @ z - wanted))
    assert (x >= 0).all() and np.linalg.norm(a @ x - wanted) <= np.linalg.norm(a @ z - wanted) + 1


def check(rows, texts, words, window):
    """Every id in exactly one piece; sequences gapless; checksums right."""
    ids = {d: np.r_[b, 2].astype("<u4") for d, b in zip(texts, words.documents([(t or "").encode() for t in texts.values()]), strict=True)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_seq)


def test_packing_documents(spark, words):
    rng = np.random.default_rng(2)
    texts = {i: " ".join(rng.choice(["the", "and", "zqx", "running"], rng.integers(0, 150))) for i in range(300)} | {300: None, 301: "", 302: "word " * 1000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"start": F.lit("clash"), "sequence_id": F.lit(1)})
    rows = packing.pack_documents(df, PATH, window=256, unit=8).collect()
    n = check(rows, texts, words, 256)
    total = sum(r.length for r in rows)
    assert total / (n * 256) > 0.93
    assert packing.pack_documents(df.limit(0), PATH, window=256).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, window=100, unit=8)


def test_workers_get_small_batches(spark, monkeypatch):
    """Whatever the session lets through at once, and its setting stays; the driver's rows are as many."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(docs, *_):
        def one(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n_rows", "n_bytes"])

        return docs.mapInArrow(one, "n_rows long, n_bytes long")

    monkeypatch.setattr(packing, "token_pieces", sizes)
    monkeypatch.setattr(packing, "pack", lambda pieces, *_: pieces)
    docs = spark.range(0, 4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    got = packing.pack_documents(docs, PATH).collect()
    assert sum(r.n_rows for r in got) == 4000 and max(r.n_bytes for r in got) < 5 << 20
    long = docs.limit(3).withColumn("text", F.repeat("text", 2000))
    assert [r.n_rows for r in packing.pack_documents(long, PATH).collect()] == [1, 1, 1]
    assert spark.conf.get(key) == before
