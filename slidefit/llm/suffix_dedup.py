"""Suffix-array dedup by distributed prefix doubling: remove bytes of 50-byte strings that start in a smaller document.

Ranks stand for prefixes of growing length: a position's rank at 8 bytes is their value; pairs of ranks at offsets 8 and 9
give ranks at 16 and 25 bytes, and pairs at offset 25 the rank at 50, past which nothing is compared. Sorting all positions at
every length takes many times the text (ranked_repeats does that), so here positions drop out as soon as they are known to be
unique or have been settled together:

* 50 bytes hold 26 prefixes of 25 bytes; the smallest of their ranks is the position's sample, so equal 50-byte strings have
  equal samples, and neighbours mostly share one: a run. Round 1 deals the samples by value; a sample of one document only is
  unique, and so are its positions. Whole documents are ranked too; exact copies need no positions.
* Round 2 deals the other runs by their ranks at both ends, which cover all their bytes: a run that an earlier document has is
  removed as a whole. Where all runs of a sample are alike, that settles it.
* Round 3 deals the positions of what is left, one of each kind of run, by their rank at 50 bytes.

A chunk (documents of an interval of ids) sends each rank once, sorted, difference-coded and packed, to the task of its
range, and gets back bits: whether another chunk (round 1) or an earlier one (rounds 2 and 3) has it, which is all that has to
be known of other documents. However often a string occurs, a chunk sends it once: a hot passage or a huge group of copies
weighs as much as the number of chunks, and no occurrence lists exist. Samples are minima, so their ranges follow the
distribution of minima; of many equal intervals the first would have 13 times its share. Bytes are removed on equal ranks of 128 bits (digests of
whole documents, both ends of a run, 50 bytes); strings aren't compared. By the birthday bound one wrong match among 10^13
positions has a probability under 10^-12. There is a chunk for every 4 MB of text (as many as spark.sql.shuffle.partitions at least), with bounds from
approximate percentiles of the ids weighed by their texts' size, and a range for every four chunks, so the exchange has at most
a quarter of chunks^2 packed rows. An id that many rows share, or none, has chunks of its own, dealt by their texts.

Null texts count as empty; texts under the length lose nothing; rows that share a doc_id don't remove one another's bytes;
rows without an id count as the largest; an empty table gives an empty result. Very long texts are ranked block by block.
Ties: rows are alike but for their id. Further columns may be carried along, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

LENGTH, HALF = 50, 25
#: Positions that may share a sample.
WIDTH = LENGTH - HALF + 1
#: Stands for a missing id, after all others.
LAST = 2**63 - 1
#: Bytes of text ranked at a time.
BLOCK = 1 << 18
_U = np.uint64
#: The bits of a sampled rank that are compared.
_SENT = _U(2**64 - 2**20)
#: Bytes of text in a chunk, and chunks whose ranks make a range.
CHUNK, SPLIT = 1 << 22, 4
#: Bytes of text that count as one row where chunks are cut.
WEIGHT = 4096


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One rank for a pair of ranks: a 64-bit mix."""
    h = a * _U(0x9E3779B97F4A7C15) + b * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(31)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over all windows of that width, by doubling."""
    s = 1
    while 2 * s <= width:
        a = pick(a[:-s], a[s:])
        s *= 2
    return pick(a[: len(a) - (width - s)], a[width - s :]) if s < width else a


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, and the eight bytes from each position on as a number."""
    raw = np.frombuffer(b"".join(texts) + bytes(72), np.uint8)
    return raw, np.lib.stride_tricks.as_strided(raw, (len(raw) - 8, 8), (1, 1))


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of positions with one sample (26 at most, then another begins), of texts one after another: where they begin, how many
    positions they have, their sample and text number. Positions where no 50-byte string starts are in none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends, n = np.cumsum(sizes), int(sizes.sum())
    r8 = _joined(texts)[1].copy().view(">u8").ravel().astype(np.uint64)
    r16 = _pair(r8[: n + 40], r8[8 : n + 48])
    r25 = _pair(r16[: n + 30], r16[9 : n + 39])
    key = r25[: n + LENGTH - HALF] | _U(1 << 20)  # samples are never 0
    sample = _slide(key, WIDTH, np.minimum)[:n] & _SENT
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        sample[max(end - size, end - LENGTH + 1) : end] = 0
    first = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]]) if n else np.zeros(0, np.int64)
    long = np.diff(first, append=n)
    first, long = first[sample[first] > 0], long[sample[first] > 0]
    pieces = -(-long // WIDTH)
    step = WIDTH * (np.arange(pieces.sum()) - np.repeat(_starts(pieces), pieces))
    begin = np.repeat(first, pieces) + step
    return begin, np.minimum(np.repeat(long, pieces) - step, WIDTH), sample[begin], np.searchsorted(ends, begin, "right")


def ranks_at(texts: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit ranks at 50 bytes of some positions of texts one after another."""
    view = _joined(texts)[1]
    r8 = lambda k: view[at + k].view(">u8").ravel().astype(np.uint64)
    r25 = lambda k: _pair(_pair(r8(k), r8(k + 8)), _pair(r8(k + 9), r8(k + 17)))
    other = r8(0)
    for k in (8, 16, 24, 32, 40, LENGTH - 8):
        other = _pair(other ^ _U(0xA0761D6478BD642F), r8(k))
    return _pair(r25(0), r25(HALF)), other


def _encode(keys: np.ndarray) -> bytes:
    """Sorted ranks as differences, byte planes apart, compressed."""
    d = np.diff(keys, prepend=keys.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, keys.itemsize).T).tobytes(), 1)


def _decode(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def _blocks(texts: list[bytes]):
    """Ranges of texts of some BLOCK bytes."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each distinct key, in order (the first row of each), and each row's place among them."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _range_of(ranks: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the upper 32 bits; their order is kept."""
    return ((ranks >> _U(32)) * _U(ranges)) >> _U(32)


def _range_of_sample(samples: np.ndarray, ranges: int) -> np.ndarray:
    """The same for samples, which are mostly small: a rank u of [0, 1) is the smallest of one of its windows with probability
    q^25 (1 + 25 u), q = 1 - u, so the share of the samples under u is 1 - q^26 (27 - 25 q) / 2 and ranges of that are even."""
    q = 1 - (samples >> _U(32)).astype(np.float64) / 2**32
    q2 = q * q
    q8 = q2 * q2 * q2 * q2
    under = 1 - q8 * q8 * q8 * q2 * (WIDTH + 1 - (WIDTH - 1) * q) / 2
    return np.minimum((under * ranges).astype(np.int64), ranges - 1)


SENT = "to int, chunk int, keys binary, more binary, whole binary"
BACK = "chunk int, origin int, round int, bits binary, more_bits binary, whole_bits binary"


def _send(chunk: int, ranges: int, ranks: np.ndarray, more: np.ndarray | None = None, digests: np.ndarray | None = None, range_of=_range_of_sample) -> pd.DataFrame:
    """Ranks in order (samples, unless range_of says else), what belongs to them, and digests, cut by range."""
    rows = []
    cuts = np.searchsorted(range_of(ranks, ranges), np.arange(ranges + 1))
    whole = np.searchsorted(_range_of(digests[:, 0], ranges), np.arange(ranges + 1)) if digests is not None else np.zeros(ranges + 1, int)
    for k in range(ranges):
        a, b, c, d = cuts[k], cuts[k + 1], whole[k], whole[k + 1]
        if a < b or c < d:
            rows.append((k, chunk, _encode(ranks[a:b]), more[a:b].tobytes() if more is not None else None, digests[c:d].tobytes() if c < d else None))
    return pd.DataFrame(rows, columns=["to", "chunk", "keys", "more", "whole"])


def _later(keys: list[np.ndarray], turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with keys and a turn: whether an equal key has an earlier turn; the rows in order, and where keys change there."""
    order = np.lexsort((turn, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.zeros(len(order), bool)
    if len(order):
        out[order] = turn[order] > turn[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out, order, new


def _sort_range(frame: pd.DataFrame, round_: int, turns: np.ndarray) -> pd.DataFrame:
    """One range's task: sort all ranks and tell each chunk which of its own another chunk (round 1) or one of an earlier turn has;
    in round 2 also, which samples have runs of several kinds."""
    frame = frame.sort_values("chunk")
    chunks = frame["chunk"].to_numpy()
    keys = [_decode(b, np.uint64) for b in frame["keys"]]
    sizes = np.array([len(k) for k in keys])
    ranks, turn = np.concatenate(keys), np.repeat(turns[chunks], sizes)
    del keys
    several = np.zeros(len(ranks), bool)
    if round_ == 1:
        order = np.argsort(ranks, kind="stable")
        same = ranks[order[1:]] == ranks[order[:-1]]
        bits = np.zeros(len(ranks), bool)
        bits[order[1:][same]] = bits[order[:-1][same]] = True
    else:
        more = np.concatenate([np.frombuffer(b, np.uint64) for b in frame["more"]]).reshape(-1, 2 if round_ == 2 else 1)
        bits, order, new = _later([ranks, *more.T], turn)
        if round_ == 2:
            s = ranks[order]
            group = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1 if len(s) else np.zeros(0, np.int64)
            several[order] = (np.bincount(group, new) > 1)[group] if len(s) else False
    whole = [np.frombuffer(b, np.uint64).reshape(-1, 2) if b is not None else np.zeros((0, 2), np.uint64) for b in frame["whole"]]
    both, many = np.concatenate(whole), np.array([len(w) for w in whole])
    copies, _, _ = _later([both[:, 0], both[:, 1]], np.repeat(turns[chunks], many))
    pack = lambda x, e, n: np.packbits(x[e - n : e]).tobytes()
    ends, last = np.cumsum(sizes), np.cumsum(many)
    rows = [(int(c), int(t), round_, pack(bits, e, s), pack(several, e, s) if round_ == 2 else None, pack(copies, w, m)) for c, t, s, e, m, w in zip(chunks, frame["to"], sizes, ends, many, last, strict=True)]
    return pd.DataFrame(rows, columns=["chunk", "origin", "round", "bits", "more_bits", "whole_bits"])


def _lean(f, *args) -> pd.DataFrame:
    """f of args, after which the worker keeps nothing of what f has freed."""
    rows = f(*args)
    give_back()
    return rows


class Chunk:
    """A chunk's documents in order of id; every phase derives the same and goes a round further with the answers."""

    def __init__(self, frame: pd.DataFrame, ranges: int, back: pd.DataFrame | None = None):
        self.number = int(frame["chunk"].iloc[0])
        self.frame = frame.sort_values("doc_id", kind="stable").reset_index(drop=True)
        self.ids, self.texts, self.ranges, self.back = self.frame["doc_id"].to_numpy(np.int64), self.frame["text"].tolist(), ranges, back
        digests = np.array([np.frombuffer(hashlib.blake2b(t, digest_size=16).digest(), ">u8") for t in self.texts], np.uint64).reshape(-1, 2)
        first, place = _distinct(digests[:, 0], digests[:, 1])
        self.digests = digests[first]
        near = self.ids > self.ids[first][place]  # copies of a document here with a smaller id; the sort is stable, so first is the smallest
        self.copy = near if back is None else near | self._bits(1, "whole_bits", self.digests[:, 0], _range_of)[place]
        # runs of all but those copies
        found = []
        for a, b in _blocks(self.texts):
            begin, size, sample, owner = runs_of(self.texts[a:b])
            mine = np.flatnonzero(~near[a:b][owner])
            found.append((np.full(len(mine), a), begin[mine], size[mine], owner[mine] + a, sample[mine]))
        self.block, self.begin, self.size, self.owner, sample = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, t) for t in ("i8", "i8", "i8", "i8", "u8")]
        self.samples, self.place = np.unique(sample, return_inverse=True)

    def _bits(self, round_: int, column: str, ranks: np.ndarray, range_of=_range_of_sample) -> np.ndarray:
        """Answers in the order of the ranks that were sent."""
        out = np.zeros(len(ranks), bool)
        cuts = np.searchsorted(range_of(ranks, self.ranges), np.arange(self.ranges + 1))
        mine = self.back[self.back["round"] == round_]
        for o, b in zip(mine["origin"], mine[column], strict=True):
            n = cuts[o + 1] - cuts[o]
            if n:
                out[cuts[o] : cuts[o + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
        return out

    def _ranks(self, block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of positions; those of a block stand together, blocks in turn."""
        found = []
        for a, b in _blocks(self.texts):
            i, j = np.searchsorted(block, [a, b])
            if i < j:
                found.append(ranks_at(self.texts[a:b], at[i:j]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def settle(self) -> None:
        """Round 2: the runs that round 1 leaves, by kind (sample and the ranks at both ends)."""
        mine = np.flatnonzero(~self.copy[self.owner])
        low, high = np.full(len(self.samples), LAST), np.full(len(self.samples), -(2**63))
        np.minimum.at(low, self.place[mine], self.ids[self.owner[mine]])
        np.maximum.at(high, self.place[mine], self.ids[self.owner[mine]])
        mine = mine[((low < high) | self._bits(1, "bits", self.samples))[self.place[mine]]]
        self.block, self.begin, self.size, self.run_id = self.block[mine], self.begin[mine], self.size[mine], self.ids[self.owner[mine]]
        sample, n = self.samples[self.place[mine]], self.size.astype(np.uint64)
        (a1, a2), (b1, b2) = self._ranks(self.block, self.begin), self._ranks(self.block, self.begin + self.size - 1)
        one, two = _pair(_pair(a1, b1), n), _pair(_pair(a2, b2), ~n)
        # documents are in order of id and the sort is stable, so the first of a kind has the smallest id
        self.first, self.kind = _distinct(sample, one, two)
        self.kinds = sample[self.first], np.stack([one[self.first], two[self.first]], 1)

    def resolve(self) -> None:
        """Round 3: positions of one run of each kind that is neither known from earlier nor the only kind of its sample."""
        self.known, several = self._bits(2, "bits", self.kinds[0]), self._bits(2, "more_bits", self.kinds[0])
        self.open = np.flatnonzero(several & ~self.known)
        runs = self.first[self.open]
        block, begin, size, ids = self.block[runs], self.begin[runs], self.size[runs], self.run_id[runs]
        order = np.argsort(block, kind="stable")  # blocks in turn
        self.open, block, begin, size, ids = self.open[order], block[order], begin[order], size[order], ids[order]
        one, two = self._ranks(np.repeat(block, size), np.repeat(begin - _starts(size), size) + np.arange(size.sum()))
        self.position_id, self.open_size = np.repeat(ids, size), size
        first, self.at = _distinct(one, two)
        self.least = np.full(len(first), LAST)
        np.minimum.at(self.least, self.at, self.position_id)
        self.positions = one[first], two[first]

    def covered(self) -> dict[int, np.ndarray]:
        """By a block's first text: where the 50-byte strings start that go."""
        flags = self._bits(3, "bits", self.positions[0], _range_of)[self.at] | (self.position_id > self.least[self.at])
        start = np.full(len(self.first), -1)
        start[self.open] = _starts(self.open_size)
        whole = self.known[self.kind] | (self.run_id > self.run_id[self.first[self.kind]])
        out = {}
        for a in np.unique(self.block).tolist():
            mine = np.flatnonzero((self.block == a) & (whole | (start[self.kind] >= 0)))
            n = self.size[mine]
            step = np.arange(n.sum()) - np.repeat(_starts(n), n)
            gone = np.repeat(whole[mine], n)
            some = ~gone
            gone[some] = flags[(np.repeat(start[self.kind[mine]], n) + step)[some]]
            out[a] = (np.repeat(self.begin[mine], n) + step)[gone]
        return out


def _ask(frame: pd.DataFrame, back: pd.DataFrame | None, round_: int, ranges: int) -> pd.DataFrame:
    if not len(frame):
        return pd.DataFrame([], columns=["to", "chunk", "keys", "more", "whole"])
    c = Chunk(frame, ranges, back)
    if round_ == 1:
        return _send(c.number, ranges, c.samples, None, c.digests)
    c.settle()
    if round_ == 2:
        return _send(c.number, ranges, *c.kinds)
    c.resolve()
    return _send(c.number, ranges, *c.positions, range_of=_range_of)


def _remove(frame: pd.DataFrame, back: pd.DataFrame, ranges: int, columns: list[str], with_text: bool) -> pd.DataFrame:
    if not len(frame):
        return pd.DataFrame([], columns=columns)
    c = Chunk(frame, ranges, back)
    c.settle()
    c.resolve()
    gone = c.covered()
    n = len(c.texts)
    removed, spans, kept, digests = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
    for a, b in _blocks(c.texts):
        sizes = np.array([len(t) for t in c.texts[a:b]])
        ends = np.cumsum(sizes)
        step = np.bincount(gone.get(a, np.zeros(0, np.int64)), minlength=int(ends[-1]) + 1).astype(np.int32)
        step[LENGTH:] -= step[:-LENGTH].copy()
        cover = np.cumsum(step[:-1]) > 0
        raw = np.frombuffer(b"".join(c.texts[a:b]), np.uint8)
        for k in range(a, b):
            lo, hi = ends[k - a] - sizes[k - a], ends[k - a]
            own, rest = cover[lo:hi], c.texts[k]
            if c.copy[k] and hi - lo >= LENGTH:
                removed[k], spans[k], rest = hi - lo, 1, b""
            elif own.any():
                removed[k] = own.sum()
                spans[k] = int(own[0]) + np.count_nonzero(own[1:] & ~own[:-1])
                rest = raw[lo:hi][~own].tobytes()
            digests.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                kept.append(rest.decode("utf-8", "ignore"))
    out = c.frame.drop(columns=["text", "chunk"])
    out["n_bytes"], out["n_removed"], out["n_spans"], out["kept_sha256"] = [len(t) for t in c.texts], removed, spans, digests
    if with_text:
        out["kept_text"] = kept
    return out[columns]


def _deal(bounds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From percentiles of the ids: cuts between intervals, the first chunk of each interval and how many it has. An id that is
    several percentiles is an interval of its own with as many chunks."""
    values, many = np.unique(np.array(bounds or [], np.int64), return_counts=True)
    cuts, parts = [], [1]
    for v, n in zip(values.tolist(), many.tolist(), strict=True):
        if not cuts or cuts[-1] != v:
            cuts.append(v)
            parts.append(1)
        if n > 1:
            parts[-1] = n + 1
            if v < LAST:
                cuts.append(v + 1)
                parts.append(1)
    return np.array(cuts, np.int64), np.cumsum(parts) - parts, np.array(parts, np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, with_text: bool = False, chunk_bytes: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the carried columns and, if asked for, kept_text.

    kept_text leaves out the bytes of a character that lost some of its bytes.
    """
    spark = docs.sparkSession
    carry = carry or []
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    # steps + 1 numbers: how many pieces of WEIGHT bytes there are, and where the ids' percentiles lie
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = max(4096, 4 * parallel)
    weighed = own.select(F.explode(F.array_repeat("doc_id", (F.length("text") / WEIGHT).cast("int") + 1)).alias("doc_id"))
    pieces, bounds = weighed.agg(F.count("*"), F.percentile_approx("doc_id", [k / steps for k in range(1, steps)], 4 * steps)).first()
    chunks = min(steps, max(1, parallel, -(-pieces * WEIGHT // chunk_bytes)))
    ranges = -(-chunks // SPLIT)
    cuts, first_chunk, parts = _deal([bounds[k * steps // chunks - 1] for k in range(1, chunks)] if bounds else [])
    turns = np.repeat(np.arange(len(parts)), parts)

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series, draw: pd.Series) -> pd.Series:
        interval = np.searchsorted(cuts, ids.to_numpy(np.int64), "right")
        return pd.Series((first_chunk[interval] + draw.to_numpy(np.int64) % parts[interval]).astype(np.int32))

    text = own.withColumn("chunk", chunk_of("doc_id", F.xxhash64("text")))
    fields = [T.StructField("doc_id", T.LongType())] + [f for f in own.schema.fields if f.name.startswith("carried_")]
    fields += [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType())] * with_text
    names = [f.name for f in fields]
    by = text.groupBy("chunk")
    answers = lambda sent, r: sent.groupBy("to").applyInPandas(lambda f: _lean(_sort_range, f, r, turns), BACK)
    asker = lambda r: lambda f, b: _lean(_ask, f, b, r, ranges)
    known = answers(by.applyInPandas(lambda f: _lean(_ask, f, None, 1, ranges), SENT), 1)
    for r in (2, 3):
        known = known.unionByName(answers(by.cogroup(known.groupBy("chunk")).applyInPandas(asker(r), SENT), r))
    out = by.cogroup(known.groupBy("chunk")).applyInPandas(lambda f, b: _lean(_remove, f, b, ranges, names, with_text), T.StructType(fields))
    return out.select(F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), *[F.col(n).alias(n.removeprefix("carried_")) for n in names[1:]])
