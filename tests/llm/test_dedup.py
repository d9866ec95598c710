import collections
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slidefit.llm import near_dedup, prefix_doubling, suffix_dedup


def brute_repeats(texts):
    first = {}
    data = {d: (t or "").encode() for d, t in texts.items()}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            first.setdefault(data[d][i : i + 50], d)
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def corpus(rng):
    words = [f"w{i}é" if i % 5 == 0 else f"word{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(words, n))
    passage, line = make(30), make(9)
    texts = {i: make(rng.integers(0, 80)) for i in range(40)}
    for i in range(40, 70):
        texts[i] = make(rng.integers(0, 20)) + passage[: rng.integers(10, len(passage))] + make(rng.integers(0, 20))
    for i in range(70, 90):
        texts[i] = texts[int(rng.integers(0, 70))]
    texts |= {90: None, 91: "", 92: "a" * 300, 93: "a" * 120, 94: (line + "\n") * 20, 95: line + "\n" + line, 96: "a" * 49, 97: "a" * 50, 98: passage * 40}
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_by_brute_force(spark, seed):
    texts = corpus(np.random.default_rng(seed))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"chunk": F.lit("clash"), "lang": F.lit("xx")})
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, carry=["lang"], with_text=True).collect()}
    for d, want in brute_repeats(texts).items():
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == want, d
        assert got[d].lang == "xx"
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    t = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    rows = sorted((r.doc_id if r.doc_id is not None else 9, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert rows == [(1, 0), (1, 0), (2, len(t)), (9, len(t))]


def labelled_kmers(text):
    w, c, out = (text or "").lower().encode().split(), collections.Counter(), []
    for k in range(max(1 if w else 0, len(w) - 4)):
        g = b" ".join(w[k : k + 5])
        c[g] += 1
        out.append((g, c[g]))
    return out


def brute_classes(texts):
    grams = {d: labelled_kmers(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b:
                x, y = grams[a], grams[b]
                same = (texts[a] or "") == (texts[b] or "")
                if not same and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8:
                    # the longest common subsequence, by the plain table
                    t = np.zeros((len(x) + 1, len(y) + 1), int)
                    for i in range(len(x)):
                        for j in range(len(y)):
                            t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
                    m = t[-1, -1]
                    same = m / (len(x) + len(y) - m) >= 0.8
                if same:
                    r, s = sorted((find(a), find(b)))
                    parent[s] = r
    return {d: find(d) for d in texts}


def test_near_dedup_by_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(rng.choice(words, rng.integers(3, 120))) for i in range(40)}
    shared = " ".join(rng.choice(words, 60))
    for i in range(40, 90):
        own = texts[int(rng.integers(0, 40))].split()
        for _ in range(int(rng.integers(0, 3))):
            own[int(rng.integers(0, len(own)))] = str(rng.choice(words))
        texts[i] = " ".join(own)
    for i in range(90, 110):
        texts[i] = shared + " " + " ".join(rng.choice(words, 60))
    halves = texts[0].split()
    texts |= {110: None, 111: "", 112: " \n", 113: "Hello", 114: "hello", 115: "one two three", 116: " ".join(halves[len(halves) // 2 :] + halves[: len(halves) // 2]), 117: "la la la la la la la la", 118: "la " * 9}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"digest": F.lit("clash"), "n": F.lit(1)})
    got = {r.doc_id: r for r in near_dedup.classes(df).collect()}
    want = brute_classes(texts)
    assert {d: got[d].class_id for d in texts} == want
    assert all(got[d].kept == (want[d] == d) for d in texts)
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_template_family_by_brute_force(spark):
    """Pairs of near-copies among many texts that share most of their words: buckets hold them all, none may be missed."""
    rng = np.random.default_rng(5)
    shared = " ".join(f"s{i}" for i in range(124))
    texts = {}
    for i in range(120):
        pair = " ".join(f"p{i}x{j}" for j in range(3))
        for k in range(2):
            texts[2 * i + k] = f"{shared} {pair} " + " ".join(f"o{x}" for x in rng.integers(0, 10**6, 13))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts) == {d: d - d % 2 for d in texts}


def test_hot_groups_stay_linear(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 999, 80)]
    rows = []
    for i in range(300):
        own = list(base)
        own[i % 80] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 600 and {r.class_id for r in got} == {0}


def test_alignment_keeps_order():
    a = np.arange(100, dtype=np.uint32)
    assert near_dedup.alike(a, a, 0.8) == 1
    assert near_dedup.alike(a, np.r_[a[:95], a[96:]], 0.8) == pytest.approx(0.99)
    assert near_dedup.alike(a, np.r_[a[50:], a[:50]], 0.8) < 0.5
    assert near_dedup.alike(a, a + 1000, 0.8) == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.components(edges)[0].collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, "quite another text of seven words")], "doc_id long, text string")
    rows = sorted((r.class_id or 0, r.doc_id or 0, bool(r.kept)) for r in near_dedup.classes(df).collect())
    assert rows == [(0, 0, False), (1, 0, False), (1, 1, True)]


def test_suffix_dedup_with_hot_ids(spark):
    """Most rows share one id or have none: they are dealt over chunks, but stay one document's rows to each other."""
    rng = np.random.default_rng(7)
    texts = list(corpus(rng).values())
    ids = [None if u < 0.4 else 50 if u < 0.8 else int(100 * u) for u in rng.random(len(texts))]
    last = 10**9
    rows = [(last if d is None else d, (t or "").encode()) for d, t in zip(ids, texts, strict=True)]
    first = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], last))
    want = []
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        want.append((d, len(b), int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    got = [(last if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got) == sorted(want)


def test_chunks_of_hot_ids():
    cuts, first, parts = suffix_dedup._deal([3, 7, 7, 7, 9, suffix_dedup.LAST, suffix_dedup.LAST])
    assert cuts.tolist() == [3, 7, 8, 9, suffix_dedup.LAST] and parts.tolist() == [1, 1, 4, 1, 1, 3] and first.tolist() == [0, 1, 2, 6, 7, 8]
    assert suffix_dedup._deal([])[2].tolist() == [1]


def test_ranges_of_samples_are_even():
    rng = np.random.default_rng(5)
    texts = [rng.bytes(20_000) for _ in range(30)]
    sent = suffix_dedup._ask(pd.DataFrame({"doc_id": range(30), "text": texts, "chunk": 0}), None, 1, 16)
    keys = [suffix_dedup._decode(b, np.uint64) for b in sent["keys"]]
    sizes = [len(k) for k in keys]
    assert sent["to"].tolist() == list(range(16)) and max(sizes) < 1.2 * np.mean(sizes) and min(sizes) > 0.8 * np.mean(sizes)
    assert np.concatenate(keys).tolist() == np.unique(suffix_dedup.runs_of(texts)[2]).tolist()
    ends = np.array([0, 1, 2**31, 2**32 - 1], np.uint64) << np.uint64(32)
    assert suffix_dedup._range_of_sample(ends, 7).tolist() == [0, 0, 6, 6]
    near = (np.arange(2**20, dtype=np.uint64) + np.uint64(2**26)) << np.uint64(32)
    assert (np.diff(suffix_dedup._range_of_sample(near, 2**31)) >= 0).all()


def test_freed_memory_goes_back():
    def held():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) / 1024

    def work(frame):
        parts = [bytes(60_000) for _ in range(3000)]  # under the size that the C library maps apart
        last = bytes(60_000)
        at.append(held())
        del parts
        frame["last"] = [last]  # stands above what was freed
        return frame

    at = []
    out = suffix_dedup._lean(work, pd.DataFrame({"a": [1]}))
    assert len(out) == 1 and held() < at[0] - 100


def test_prefix_doubling_by_brute_force(spark):
    """Spark's sorted ranks give the same bytes as brute force, and so as the packed form."""
    texts = corpus(np.random.default_rng(3))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    starts = collections.defaultdict(list)
    for r in prefix_doubling.repeated_starts(df).collect():
        starts[r.doc].append(r["at"])
    for d, want in brute_repeats(texts).items():
        b = (texts[d] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in starts[d]:
            gone[i : i + 50] = True
        assert (int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()) == (want[1], want[3]), d
