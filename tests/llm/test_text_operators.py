import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from slidefit.llm import chat, compression_quality, flac, flac_reader, quality_rules, sharding, spbpe, url_filters

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_sentencepiece_round_trip(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(1)
    alphabet = list("ab  \n\t▁éß😀中文字の\x00\x1f<0x0A>theing.,!%&#$0123456789 ​́")
    texts = ["", " ", None, "▁", "a" * 3000, "the " * 500, *[" " * n + "x" for n in range(40)], *["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)]]
    rows = spbpe.round_trip(frame(spark, texts, ids="clash"), MODEL).collect()
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "")
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids) and r.decoded == lib.decode(ids), repr(texts[r.doc_id])
    d = {r.doc_id: r for r in spbpe.digests(frame(spark, texts), MODEL).collect()}
    assert all(d[r.doc_id].ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() for r in rows)
    assert spbpe.digests(frame(spark, texts).limit(0), MODEL).count() == 0


def test_every_token_is_compatible_with_itself():
    """The prefix table against plain merging, on pairs of vocabulary entries."""
    e = spbpe.PrefixEncoder(open(MODEL, "rb").read())
    rng = np.random.default_rng(2)
    pieces = [p for p in e.pieces if not p.startswith("▁▁")]
    for _ in range(2000):
        s = "".join(rng.choice(pieces, 3)).replace("▁", "") or "x"
        assert e.table(s) == [e.pieces[x] for x in e.merge(s)], s


def test_chat(spark):
    bits = ["\\", "<turn>", "</turn>", "<says>", "\n", " ", "é", "😀", "<", "<|endoftext|>", "ok", "<\\turn>"]
    rng = np.random.default_rng(3)
    rows = [(c, t, rng.choice(["user", "assistant", "sys<turn>"]), "".join(rng.choice(bits, rng.integers(0, 7)))) for c in range(60) for t in range(rng.integers(1, 6))]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (None, 0, "user", "x"), (101, 0, "assistant", "a"), (101, 0, "assistant", "a")]
    rows = [(c, t, None if r is None else str(r), x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append((t, r or "", x or ""))
    assert set(got) == set(conv)
    for c, turns in conv.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_flac_is_lossless(spark):
    rng = np.random.default_rng(4)
    blocks = [b"", b"a", bytes(1000), rng.bytes(3000), bytes([0, 255] * 700), b"ab" * 300 + b"\xff" * 400, bytes(range(256)) * 5]
    blocks += [bytes(np.where(rng.random(600) < 0.02, rng.integers(0, 256, 600), 128).astype(np.uint8)) for _ in range(60)]
    blocks += [bytes((128 + 100 * np.sin(np.arange(3000) / 17)).astype(np.uint8))]
    payloads = [flac.payload_of(b) for b in blocks]
    streams = flac.encode(payloads)
    for p, got in zip(payloads, flac.decode(streams), strict=True):
        assert b"".join(x for _, x in got) == p and [k for k, _ in got] == list(range(0, len(p), flac.FRAME))
    assert len(streams[-1]) < 0.7 * len(payloads[-1])  # a smooth signal is predicted
    for at in (5, 30, len(streams[3]) // 2, len(streams[3]) - 3):
        bad = bytearray(streams[3])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    texts = ["", None, "héllo", "x" * 64, "y" * 5000, "y" * 5000]
    media = flac.to_media(frame(spark, texts, media="clash"))
    rows = {r.doc_id: r for r in flac.described(media).collect()}
    assert rows[0].payload_bytes == rows[1].payload_bytes == rows[3].payload_bytes == 64 and rows[2].n_bytes == 6
    assert rows[4].media_sha256 == rows[5].media_sha256
    pcm = {(r.doc_id, r.sample_offset): bytes(r.pcm) for r in flac.pcm_blocks(media).collect()}
    assert pcm[4, 512] == b"y" * 512
    assert flac.described(flac.to_media(frame(spark, texts).limit(0))).count() == 0


def test_statistics_by_brute_force():
    rng = np.random.default_rng(5)
    vocabulary = ["a", "bb", "c#", "d!", "é", " x", " "]
    for n in (0, 1, 7, 8, 9, 40, 300):
        for _ in range(30):
            words = list(rng.choice(vocabulary[: rng.integers(1, 8)], n))
            x = "".join(w + rng.choice([" ", "\n", "\t", " \n"]) for w in words)
            w = re.findall("[^\x20\x09-\x0d]+", x)
            many = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            covered = {k for i in range(len(w) - 7) if many[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
            seen, dup = set(), 0
            for line in x.split("\n"):
                if re.search("[^\x20\x09-\x0d]", line):
                    dup += line in seen
                    seen.add(line)
            assert quality_rules.statistics(x.encode())[:5] == (len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(6)
    x = rng.random((4000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2) | (rng.random(4000) < 0.02)).astype(float)
    t = quality_rules.grow(x[:3000], y[:3000], [-1, 1, 0])
    assert ((t.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    base = rng.random((50, 3))
    for j, sign in ((0, -1), (1, 1)):
        line = np.repeat(base, 40, 0)
        line[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(t.margin(line).reshape(50, 40), axis=1) >= -1e-9).all()


def good(rng):
    return " ".join(rng.choice(["the", "house", "river", "stone", "walks", "over", "green"], 60)) + "."


def bad(rng):
    return " ".join(rng.choice(["buy###", "NOW!!", "$$$win", "%%%", "click***"], 60))


def labelled(spark, n=240):
    rng = np.random.default_rng(7)
    rows = [(i, bad(rng) if i % 3 == 0 else good(rng)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int")


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    more = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "a b"), (903, "same words again and again here now " * 30)], docs.schema)).withColumn("n_words", F.lit("clash"))
    rows = {r.doc_id: r for r in quality_rules.apply(more, labels).collect()}
    assert all(rows[i].base_failed and not rows[i].kept for i in (900, 901, 902, 903)) and rows[900].n_words == 0
    assert np.mean([rows[i].kept == (i % 3 > 0) for i in range(240)]) > 0.97
    unlabelled = quality_rules.apply(docs, labels.limit(0)).collect()
    assert all(r.kept and r.score is None for r in unlabelled)
    assert quality_rules.apply(docs.limit(0), labels).count() == 0


def test_compression_quality(spark):
    docs, labels = labelled(spark)
    model = compression_quality.fit(docs, labels, F.col("doc_id") % 2 == 0)
    more = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "x" * 100_000)], docs.schema)).withColumn("score", F.lit("clash"))
    rows = {r.doc_id: r.score for r in compression_quality.score(more, model).collect()}
    held = [i for i in range(240) if i % 2]
    assert np.mean([(rows[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    assert rows[900] == rows[901] and all(0 <= v <= 1 for v in rows.values())
    assert compression_quality.fit(docs, labels.where("quality = 1")) == 1.0 and compression_quality.fit(docs, labels.limit(0)) == 0.5
    assert compression_quality.score(docs.limit(0), model).count() == 0
    assert compression_quality.score(docs, 0.5).first().score == 0.5


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 1009)
    share = np.bincount(table, minlength=7)
    assert share.max() - share.min() <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    assert (fewer[table != 6] == table[table != 6]).mean() > 0.75  # most slots stay
    for wrong in ((names, 1000), ([], 1009), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*wrong)
    df = spark.createDataFrame([(i, "x") for i in range(500)] + [(None, None), (3, "again")], "doc_id long, shard string")
    rows = sharding.place(df, names, 1009).collect()
    for r in rows:
        want = 0 if r.doc_id is None else int(hashlib.sha256(str(r.doc_id).encode()).hexdigest()[:15], 16) % 1009
        assert r.slot == want and r.shard == names[table[want]]
    assert sharding.place(df.limit(0), names, 1009).count() == 0


def test_writing_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), ["a", "b", "c"], 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_url_filters(spark):
    rng = np.random.default_rng(8)
    hosts = ["a.com", "x.a.com", "b.org", "c.net", "localhost"]
    events = [("L", str(rng.choice(hosts)), int(rng.integers(0, 30)), str(rng.choice(["add", "remove"]))) for _ in range(60)] + [("L", None, 3, "add"), ("L", "b.org", None, "add")]
    urls = ["http://y.x.a.com/p", "https://user@A.com:80/?q", "http://b.org", "nothing", None, "ftp://localhost/x"]
    captures = [(i, urls[i % 6], None if i == 50 else int(rng.integers(0, 35))) for i in range(120)]
    ev = spark.createDataFrame(events, "list string, host string, at long, action string")
    cap = spark.createDataFrame(captures, "page_id long, url string, fetched_at long").withColumn("blocked", F.lit("clash"))
    got = {r.page_id: r for r in url_filters.judge(cap, ev).collect()}

    def active(host, t):
        state, since = False, None
        for _, _, at, action in sorted([e for e in events if e[1] == host and e[2] is not None and e[2] <= t], key=lambda e: (e[2], e[3] == "remove")):
            if (action == "add") != state:
                state, since = action == "add", at
        return since if state else None

    for i, url, t in captures:
        m = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:?]*)", (url or "").lower())
        host = m[1] if m else ""
        own = [".".join(host.split(".")[k:]) for k in range(len(host.split(".")) - 1)] or [host]
        hits = [h for h in own if t is not None and active(h, t) is not None]
        assert got[i].n_matches == len(hits) and got[i].blocked == bool(hits), (url, t)
        assert got[i].matched_host == (max(hits, key=len) if hits else None)
    assert url_filters.judge(cap, ev.limit(0)).where("blocked").count() == 0
    assert url_filters.judge(cap.limit(0), ev).count() == 0


def test_url_filters_of_repeated_and_null_ids(spark):
    ev = spark.createDataFrame([("L", "a.com", 5, "add")], "list string, host string, at long, action string")
    rows = [(1, "http://x.a.com/", 9)] * 3 + [(None, "http://x.a.com/", 9)] * 2 + [(None, "http://x.a.com/", None)] * 2 + [(None, None, None)] * 2
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, fetched_at long"), ev).collect()
    assert sorted((r.page_id or 0, r.host, r.fetched_at or 0, r.n_matches, r.matched_host, r.blocked) for r in got) == sorted(
        [(1, "x.a.com", 9, 1, "a.com", True)] * 3 + [(0, "x.a.com", 9, 1, "a.com", True)] * 2 + [(0, "x.a.com", 0, 0, None, False)] * 2 + [(0, "", 0, 0, None, False)] * 2
    )


def test_curve_is_monotonic():
    x = np.array([[d, 0.5] for d in np.linspace(-1, 1, 50)])
    w = compression_quality.curve(x, (x[:, 0] > 0.1).astype(float))
    assert w[0] > 0


class Writer:
    """Bits of a hand-made stream."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += "0" * (u >> k) + "1"
        return self.put(u, k)

    def bytes(self):
        b = self.bits + "0" * (-len(self.bits) % 8)
        return int(b, 2).to_bytes(len(b) // 8, "big")


def plain_crc(b, width, polynomial):
    c = 0
    for x in b:
        c ^= x << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c >> (width - 1) & 1 else c << 1) & ((1 << width) - 1)
    return c


def hand_made_frame(number, n, channel, size_code, subframes, variable=False):
    w = Writer().put(0x3FFE, 14).put(0, 1).put(int(variable), 1).put(6, 4).put(13, 4).put(channel, 4).put(size_code, 3).put(0, 1)
    w.put(number, 8).put(n - 1, 8).put(4410, 16)
    w.put(plain_crc(w.bytes(), 8, 0x07), 8)
    for s in subframes:
        s(w)
    body = w.bytes()
    return body + plain_crc(body, 16, 0x8005).to_bytes(2, "big")


def hand_made_stream(frames, block, channels, bits, samples, pcm, extra=b""):
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC" + (b"\x00" if extra else b"\x80") + len(info).to_bytes(3, "big") + info + extra + b"".join(frames)


def test_flac_of_other_encoders(spark):
    """Wasted bits, unencoded partitions, 5-bit parameters, linear prediction, all stereo modes, no or a sparse seek table."""
    x = np.array([40, 44, 52, 48, 60, 72, 68, 80, 100, 96, 88, 84, 80, 76, 72, 80], np.int64)

    def wasted_fixed(w):  # samples are multiples of 4: two bits wasted; order 1; two partitions, the second unencoded in 6 bits
        y = x >> 2
        w.put(0, 1).put(9, 6).put(1, 1).put(1, 2).put(int(y[0]), 14)
        w.put(0, 2).put(1, 4).put(2, 4)
        d = np.diff(y)
        for r in d[:7]:
            w.rice(int(r), 2)
        w.put(15, 4).put(6, 5)
        for r in d[7:]:
            w.put(int(r), 6)

    def linear_wide(w):  # order 2 with weights 2, -1 in units of 1/2; 5-bit parameters
        w.put(0, 1).put(33, 6).put(0, 1).put(int(x[0]), 16).put(int(x[1]), 16).put(4, 4).put(1, 5).put(4, 5).put(-2, 5)
        w.put(1, 2).put(0, 4).put(3, 5)
        for i in range(2, 16):
            w.rice(int(x[i] - ((4 * x[i - 1] - 2 * x[i - 2]) >> 1)), 3)

    frames = [hand_made_frame(0, 16, 0, 4, [wasted_fixed]), hand_made_frame(1, 16, 0, 4, [linear_wide])]
    want = np.r_[x, x]
    mono = hand_made_stream(frames, 16, 1, 16, 32, want.astype("<i2").tobytes(), b"\x83\x00\x00\x12" + (0).to_bytes(8, "big") + (0).to_bytes(8, "big") + (16).to_bytes(2, "big"))
    about, got = flac_reader.read(mono)
    assert about["bits"] == 16 and [k for k, _ in got] == [0, 16] and np.array_equal(np.concatenate([f for _, f in got]).ravel(), want)

    def verbatim(v, bits):
        return lambda w: [w.put(0, 1).put(1, 6).put(0, 1), [w.put(int(a), bits) for a in v]]

    left, right = x, x[::-1] - 7
    pairs = {1: [(left, 16), (right, 16)], 8: [(left, 16), (left - right, 17)], 9: [(left - right, 17), (right, 16)], 10: [((left + right) >> 1, 16), (left - right, 17)]}
    frames = [hand_made_frame(16 * i, 16, c, 4, [verbatim(v, b) for v, b in p], variable=True) for i, (c, p) in enumerate(pairs.items())]
    both = np.tile(np.stack([left, right], 1), (4, 1))
    stereo = hand_made_stream(frames, 16, 2, 16, 64, both.astype("<i2").tobytes())
    _, got = flac_reader.read(stereo)
    assert [k for k, _ in got] == [0, 16, 32, 48] and np.array_equal(np.concatenate([f for _, f in got]), both)
    constant = lambda w: w.put(0, 1).put(0, 6).put(0, 1).put(-5, 8)
    small = hand_made_stream([hand_made_frame(0, 16, 0, 1, [constant])], 16, 1, 8, 16, np.full(16, -5, np.int8).tobytes())
    own = flac.encode([flac.payload_of(b"mixed batch" * 200)])[0]
    rows = spark.createDataFrame([(1, bytearray(mono)), (2, bytearray(stereo)), (3, bytearray(small)), (4, bytearray(own)), (5, None)], "doc_id long, media binary")
    blocks = collections.defaultdict(bytes)
    for r in sorted(flac.pcm_blocks(rows).collect(), key=lambda r: (r.doc_id, r.sample_offset)):
        blocks[r.doc_id] += bytes(r.pcm)
    assert blocks == {1: want.astype("<i2").tobytes(), 2: both.astype("<i2").tobytes(), 3: bytes([0x80 - 5] * 16), 4: flac.payload_of(b"mixed batch" * 200)}
    for stream in (mono, stereo, small):
        for at in range(0, len(stream), 3):
            bad = bytearray(stream)
            bad[at] ^= 4
            try:
                _, got = flac_reader.read(bytes(bad))
            except ValueError:
                continue
            assert at < (64 if stream is mono else 42)  # what only describes the stream


def test_the_fast_decoder_agrees_with_the_general_one():
    rng = np.random.default_rng(14)
    payloads = [flac.payload_of(bytes(np.clip(128 + np.cumsum(rng.integers(-3, 4, 900)), 0, 255).astype(np.uint8))) for _ in range(5)] + [flac.payload_of(rng.bytes(700)), bytes(64)]
    for p, s in zip(payloads, flac.encode(payloads), strict=True):
        _, frames = flac_reader.read(s)
        assert b"".join((x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes() for _, x in frames) == p


def test_media_columns_are_written_and_read_back(spark, tmp_path):
    texts = ["media " * 300, "", None]
    flac.to_media(frame(spark, texts)).write.parquet(str(tmp_path / "media"))
    rows = {r.doc_id: r for r in flac.described(spark.read.parquet(str(tmp_path / "media"))).collect()}
    assert rows[0].payload_sha256 == hashlib.sha256(flac.payload_of(texts[0].encode())).hexdigest() and rows[2].payload_bytes == 64


def test_tables_are_filled_in_turns():
    """The plain definition: shards in turn take the first free slot of their own permutation."""
    names, slots = [f"n{i}" for i in range(5)], 211
    own = [[(sharding._hash(s, "offset") + k * (sharding._hash(s, "skip") % (slots - 1) + 1)) % slots for k in range(slots)] for s in names]
    table, free = [None] * slots, set(range(slots))
    while free:
        for i, order in enumerate(own):
            if free:
                at = next(s for s in order if s in free)
                table[at] = i
                free.remove(at)
    assert sharding.fill_table(names, slots).tolist() == table


def test_array_scoring_walks_the_nodes():
    rng = np.random.default_rng(10)
    x = rng.random((800, 4))
    t = quality_rules.grow(x, (x[:, 0] + 0.3 * x[:, 2] > 0.6).astype(float), [1, 0, 0, -1], rounds=7)
    for row, got in zip(x[:60], t.margin(x[:60]), strict=True):
        total = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (1 if row[f[node]] <= c[node] else 2)
            total += v[node - len(f)]
        assert got == pytest.approx(total, abs=1e-12)


def test_quality_rules_on_held_out_rows(spark):
    docs, labels = labelled(spark, 600)
    stats = quality_rules.document_statistics(docs)
    trees = quality_rules.fit(stats, labels.where("doc_id % 4 < 2"))
    judged = {r.doc_id: r.kept for r in quality_rules.judge(stats, trees).collect()}
    held = [i for i in range(600) if i % 4 >= 2]
    assert np.mean([judged[i] == (i % 3 > 0) for i in held]) > 0.97


def test_samples_stay_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 2, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)] * 10, "doc_id long, quality int")
    assert len(compression_quality.sample(docs, labels, None, 3, 1000)) == 6
    seen = []
    grow, quality_rules.grow = quality_rules.grow, lambda x, y, signs: seen.append(len(y))
    try:
        quality_rules.fit(quality_rules.document_statistics(docs), labels, rows=400)
    finally:
        quality_rules.grow = grow
    assert seen == [400]  # of 600 joined rows


def test_edges_of_every_text_operator(spark):
    """Null and repeated ids, null, empty and very long texts, repeated rows, columns of clashing names."""
    from slidefit.llm import near_dedup, packing, suffix_dedup

    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, "plain words here"), (1, "plain words here"), (None, "plain words here"), (None, None), (2, ""), (3, None), (4, long), (5, long), (6, "é" * 50_000), (7, " ")]
    clash = {"n": 1, "bin": 2, "salt": 3, "media": "m", "score": "s", "shard": "x", "slot": 9, "chunk": 4, "digest": "d", "ids": "i", "length": 5, "start": 6, "n_bytes": 7, "text_": "t"}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in clash.items()})
    ids = sorted((-1 if d is None else d) for d, _ in rows)
    same = lambda got, column="doc_id": sorted(-1 if r[column] is None else r[column] for r in got) == ids
    docs, labels = labelled(spark, 60)
    classes = near_dedup.classes(df).collect()
    assert same(classes) and len({r.class_id for r in classes if r.doc_id in (4, 5)}) == 1
    pieces = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), 512, 2).collect()
    assert {(-1 if r.doc_id is None else r.doc_id) for r in pieces} == set(ids) and sum(r.length for r in pieces if r.doc_id == 4) == next(r.doc_tokens for r in pieces if r.doc_id == 4)
    assert sum(r.start == 0 for r in pieces) == len(rows)
    assert same(sharding.place(df, ["a", "b"], 101).collect())
    cut = suffix_dedup.remove_repeats(df).collect()
    assert same(cut) and {r.n_removed for r in cut if r.doc_id == 5} == {len(long)} and {r.n_removed for r in cut if r.doc_id == 4} == {0}
    assert same(flac.described(flac.to_media(df)).collect())
    assert same(compression_quality.score(df, compression_quality.fit(docs, labels)).collect())
    assert same(spbpe.digests(df, MODEL).collect())
    assert same(quality_rules.apply(df, labels).collect())
