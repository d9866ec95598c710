"""Packing token sequences into fixed windows: non-negative least squares over shallow length combinations.

1. Every document is tokenized once and cut at multiples of the window; its remainder stays whole.
2. Piece lengths, rounded up to a unit, form a histogram of window/unit bins, whatever the size of the corpus.
3. All combinations of at most three bins that fill a window exactly are enumerated; an active-set NNLS solves how often
   each is repeated so that the histogram is used up. Counts are rounded and clipped to what the histogram holds.
4. What is left is packed greedily (longest first, tightest open window) on the histogram itself.
5. Pieces are numbered within their bin (salted, so one very common length doesn't meet in one task) and find their
   window by binary search in the plan. Only histograms and the plan, bounded by the window, reach the driver.

Null texts count as empty: a document has its end token at least, so it always has one piece. An empty table gives an
empty result. Repeated rows are packed each; rows without an id keep a null one. Very long texts are cut like others; a batch
holds some 4 MB of text or one document, after which a worker hands freed memory back. Of equal lengths, the smaller id and
start come first. Further columns of docs are left behind.
"""

from __future__ import annotations

import json
import logging
import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, read_bytes, slices, small_batches, texts, write_table

log = logging.getLogger(__name__)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Long words and pre-tokens, slots for short words and ids of words that a worker remembers before it starts anew.
KNOWN_WORDS, KNOWN_PARTS, SLOTS, POOL = 200_000, 200_000, 1 << 21, 1 << 23
#: Ids that a block may add to a full pool before the pool grows; a pool is touched only as far as it is used.
SPARE = 1 << 20
#: Bytes of text looked up at a time, and those that a worker gets at a time.
BLOCK, BATCH = 1 << 19, 1 << 22
#: The tokenizer's pattern for lower-case words up to U+017F: letters, contractions, single digits, runs of other marks; and line ends.
_LETTERS, _DIGITS, _SPACE = "a-zA-Zªµº\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff\\u0100-\\u017f", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_parts = re.compile(f"[{_LETTERS}]+|\n|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+").findall
_WORD_END = "</w>"
#: Stands between the ids of words.
_CUT = 2**32 - 1

_U = np.uint64
_state: dict = {}


class Known(dict):
    """Token bytes by pre-token; a key that is asked for in vain is noted."""

    def __init__(self):
        self.new: set[str] = set()

    def __missing__(self, part: str) -> None:
        self.new.add(part)


_RECORD = np.dtype([("first", "u8"), ("last", "u8"), ("start", "u4"), ("size", "u1"), ("n", "u1")])
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1] * 9, np.uint64)
SHORT = 16


class WordTokens:
    """Token ids of texts by their words, each encoded once.

    A text is cut at ASCII white space, over which no token reaches. A word of letters up to U+017F is lower-cased and cut as
    the tokenizer's own pattern cuts it; in that range no letter's normal form or lower case depends on its neighbours (the
    dotted capital I aside). Any other word goes to the tokenizer whole. Pre-tokens are encoded many at a time: the last token
    of each is one that ends a word, and no other is.

    Words of at most 16 bytes are looked up for a whole block at once, in a table of two places a slot that holds their first
    and last eight bytes and their length, which are the word; longer ones in a dictionary. Ids lie in one pool, with 16 bits each
    if the vocabulary allows.
    """

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.long, self.parts = Tokenizer.from_str(blob.decode()), {}, Known()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        plain = json.loads(blob) | {"normalizer": None, "added_tokens": []}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *[x for x in plain["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel"]]}
        self.plain = Tokenizer.from_str(json.dumps(plain))  # for pre-tokens, which need no cutting any more
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for v, k in vocabulary.items() if v.endswith(_WORD_END)]] = True
        self.table, self.pool, self.used = np.zeros(SLOTS, _RECORD), np.zeros(POOL + SPARE, "<u2" if len(self.ends) <= 1 << 16 else "<u4"), 0

    def _ids(self, texts: list[str], plain: bool = False) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in (self.plain if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, parts: list[str]) -> list[bytes]:
        """Token bytes of pre-tokens."""
        out: list[bytes] = []
        for at in range(0, len(parts), 1024):
            some = parts[at : at + 1024]
            raw = self._ids([" ".join(some)], True)[0]
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
            if len(cuts) == len(some) and cuts[-1] == len(raw):
                out += [raw[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                out += self._ids(some, True)
        return out

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of words without white space into the pool: where they start and how many they are."""
        n = np.zeros(len(words), np.int64)
        joined = b"\n".join(words)
        raw = np.frombuffer(joined, np.uint8)
        odd = raw >= 0xC6  # what lies beyond U+017F, the dotted capital I (C4 B0), <|
        odd[:-1] |= (raw[:-1] == 0xC4) & (raw[1:] == 0xB0) | (raw[:-1] == 60) & (raw[1:] == 124)
        far = np.unique(np.searchsorted(np.cumsum([len(w) + 1 for w in words]), np.flatnonzero(odd), "right"))
        near, ids = np.setdiff1d(np.arange(len(words)), far), []
        if len(near):
            text = (b"\n".join([words[k] for k in near.tolist()]) if len(far) else joined).decode("utf-8", "replace")
            parts = self.parts
            parts["\n"] = _CUT.to_bytes(4, "little")
            cut = _parts(text.lower())
            got = list(map(parts.__getitem__, cut))
            if parts.new:
                new = list(parts.new)
                parts.new.clear()
                parts.update(zip(new, self.encode(new), strict=True))
                got = list(map(parts.__getitem__, cut))
            some = np.frombuffer(b"".join(got), "<u4")
            n[near] = np.diff(np.flatnonzero(some == _CUT), prepend=-1, append=len(some)) - 1
            ids.append(some[some != _CUT])
            if len(parts) > KNOWN_PARTS:
                parts.clear()
        for at in range(0, len(far), 1024):
            some = far[at : at + 1024].tolist()
            for k, own in zip(some, self._ids([words[k].decode("utf-8", "replace") for k in some]), strict=True):
                n[k] = len(own) // 4
                ids.append(np.frombuffer(own, "<u4"))
        order = np.concatenate([near, far])
        total, start = int(n.sum()), np.zeros(len(words), np.int64)
        start[order] = self.used + np.cumsum(n[order]) - n[order]
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(total + SPARE, self.pool.dtype)])
        if total:
            self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.used += total
        return start, n

    def block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end."""
        if self.used > POOL or len(self.long) > KNOWN_WORDS:
            self.table, self.used, self.long = np.zeros(SLOTS, _RECORD), 0, {}
            if len(self.pool) > POOL + SPARE:  # a very long text came by
                self.pool = np.zeros(POOL + SPARE, self.pool.dtype)
        joined = bytes(8) + b"\n".join(texts) + b"\n" + bytes(8)
        raw = np.frombuffer(joined, np.uint8)
        own = raw[8:-8]
        space = (own == 32) | ((own >= 9) & (own <= 13))
        turn = np.flatnonzero(np.diff(space, prepend=True)) + 8  # words begin and end in turn; the last byte is white space
        begin, end = turn[::2], turn[1::2]
        size = end - begin
        eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1)).copy().view("<u8").ravel()
        few = np.minimum(size, SHORT)
        first = eight[begin] & _HEAD[few]
        last = np.where(size > 8, eight[end - 8], _U(0))
        slot = first * _U(0x9E3779B97F4A7C15) + last * _U(0xC2B2AE3D27D4EB4F) + few.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        slot ^= slot >> _U(29)
        slot = ((slot * _U(0xA0761D6478BD642F)) >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)

        def found(at: np.ndarray, k=slice(None)) -> np.ndarray:
            r = self.table[at]
            start[k], n[k] = r["start"], r["n"]
            return (r["first"] == first[k]) & (r["last"] == last[k]) & (r["size"] == size[k])

        start, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        open_ = np.flatnonzero(~found(slot))
        open_ = open_[~found(slot[open_] ^ 1, open_)]
        if len(open_):
            words = [joined[a:b] for a, b in zip(begin[open_].tolist(), end[open_].tolist(), strict=True)]
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            distinct = list(number)
            places = np.array([self.long.get(w, (-1, 0)) if len(w) > SHORT else (-1, 0) for w in distinct], np.int64).reshape(-1, 2)
            new = np.flatnonzero(places[:, 0] < 0)
            places[new] = np.stack(self.learn([distinct[k] for k in new.tolist()]), 1)
            self.long.update((w, p) for w, p in zip(distinct, map(tuple, places.tolist()), strict=True) if len(w) > SHORT)
            start[open_], n[open_] = places[np.fromiter(map(number.__getitem__, words), np.int64, len(words))].T
            put = open_[(size[open_] <= SHORT) & (n[open_] <= 255)]
            at = slot[put]
            at = np.where(self.table["size"][at] == 0, at, at ^ 1)
            record = np.zeros(len(put), _RECORD)
            record["first"], record["last"], record["start"], record["size"], record["n"] = first[put], last[put], start[put], size[put], n[put]
            self.table[at] = record
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(start - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].astype("<u4")
        bounds = np.cumsum([len(t) + 1 for t in texts]) + 8
        return ids, np.r_[0, stop][np.searchsorted(begin, bounds)]

    def documents(self, texts: list[bytes]):
        """Little-endian 32-bit ids of each UTF-8 text."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size == 0 or size < BLOCK):
                size += len(texts[to])
                to += 1
            ids, ends = self.block(texts[at:to])
            a = 0
            for b in ends.tolist():
                yield ids[a:b]
                a = b
            at = to


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. Documents longer than the window are cut at its multiples."""
    blob = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))
    end = np.array([end_id], "<u4")

    def cut(batches):
        if _state.get("key") != (tokenizer_path, len(blob.value)):
            _state.update(key=(tokenizer_path, len(blob.value)), words=WordTokens(blob.value))
        names = [f.split()[0] for f in PIECES.split(", ")]
        for b in batches:
            for part in slices(b, 1, BATCH):
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), _state["words"].documents(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, end)
                    n = len(ids)
                    rows += [(doc, s, min(window, n - s), zlib.crc32(ids[s : s + window]), n) for s in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                give_back()

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, PIECES)


def combinations(bins: int, depth: int = 3) -> np.ndarray:
    """All multisets of at most three bin numbers whose sum is bins; zeros fill the unused places."""
    out = [(bins, 0, 0)]
    if depth >= 2:
        out += [(bins - a, a, 0) for a in range(1, bins // 2 + 1)]
    if depth >= 3:
        out += [(bins - a - b, b, a) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    return np.array(out)


def solve_nnls(patterns: np.ndarray, wanted: np.ndarray, rounds: int = 200) -> np.ndarray:
    """min |A x - wanted|, x >= 0, by an active-set method; column j of A counts the bins of patterns[j]. wanted[0] is ignored.

    It ends when no combination's gradient exceeds a quarter of a piece, when a round brings nothing, or after rounds; the
    latter two are logged. What is off then goes to the greedy packing, so no piece is lost.
    """
    bins, n = len(wanted), len(patterns)
    scale = max(1.0, float(wanted.max(initial=0)))
    goal = wanted / scale
    goal[0] = 0
    x, active = np.zeros(n), np.zeros(n, bool)

    def matrix(at: np.ndarray) -> np.ndarray:
        a = np.zeros((bins, len(at)))
        for k in range(patterns.shape[1]):
            np.add.at(a, (patterns[at, k], np.arange(len(at))), 1.0)
        a[0] = 0
        return a

    usable = np.all(goal[patterns] + (patterns == 0) > 0, axis=1)  # a bin without pieces can't be used
    off, stop = np.inf, "rounds used up"
    for _ in range(rounds):
        rest = goal.copy()
        at = np.flatnonzero(active)
        if len(at):
            rest -= matrix(at) @ x[at]
        if off - (off := float(rest @ rest)) <= 1e-9 * off:
            stop = "no better than the round before"
            break
        gain = rest[patterns].sum(1)
        gain[active | ~usable] = -1
        if gain.max(initial=-1) < 0.25 / scale:  # a quarter of a piece: rounding wouldn't see it
            stop = "solved"
            break
        # several columns without a bin in common enter at once
        taken, entered, enough = np.zeros(bins, bool), 0, 0.3 * gain.max()
        for j in np.argsort(-gain, kind="stable")[:512]:
            own = patterns[j][patterns[j] > 0]
            if gain[j] <= enough or taken[own].any():
                continue
            taken[own], active[j], entered = True, True, entered + 1
            if entered == 48:
                break
        while True:
            at = np.flatnonzero(active)
            a = matrix(at)
            gram = a.T @ a
            z = np.linalg.solve(gram + 1e-10 * np.eye(len(at)), a.T @ goal)
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            now = x[at]
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300))
            now = now + min(1.0, max(0.0, step)) * (z - now)
            now[bad & (now <= 1e-12)] = 0
            if not (now[bad] == 0).any():
                now[np.flatnonzero(bad)[np.argmin(now[bad])]] = 0
            x[:] = 0
            x[at] = now
            active[at[now <= 0]] = False
            if not active.any():
                break
    if stop != "solved":
        log.info("NNLS stopped (%s), %.4g pieces off the histogram", stop, scale * off**0.5)
    return x * scale


def greedy(left: np.ndarray, bins: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest bin first into the tightest open window, on counts; (combination, repeats)."""
    open_: dict[int, list] = defaultdict(list)
    for q in range(bins, 0, -1):
        n = int(left[q])
        while n:
            room = next((r for r in range(q, bins) if open_.get(r)), None)
            if room is None:
                each = bins // q
                for combo, m in (((q,) * each, n // each), ((q,) * (n % each), 1 if n % each else 0)):
                    if m:
                        open_[bins - q * len(combo)].append((combo, m))
                break
            combo, m = open_[room].pop()
            fit = min(room // q, n)
            if fit * m <= n:  # every window of the group takes as many as fit
                t = m
            else:
                t, fit = (n // fit, fit) if n >= fit else (1, n)
            if t < m:
                open_[room].append((combo, m - t))
            open_[room - fit * q].append((combo + (q,) * fit, t))
            n -= t * fit
    return [g for groups in open_.values() for g in groups]


def plan(counts: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is repeated; together they hold counts[q] pieces of every bin q exactly."""
    bins, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    if left[1:].sum() == 0:
        return out
    full, left[bins] = int(left[bins]), 0  # whole windows need no solving
    if full:
        out.append(((bins,), full))
    patterns = combinations(bins, depth)
    x = solve_nnls(patterns, left.astype(float))
    for j in np.argsort(-x, kind="stable"):
        n = int(round(x[j]))
        if n <= 0:
            break
        own, many = np.unique(patterns[j][patterns[j] > 0], return_counts=True)
        n = min(n, int((left[own] // many).min()))
        if n > 0:
            left[own] -= n * many
            out.append((tuple(sorted(patterns[j][patterns[j] > 0].tolist(), reverse=True)), n))
    return out + greedy(left, bins)


def lookup(combos: list[tuple[tuple[int, ...], int]], bins: int) -> list[dict]:
    """Per bin, runs of ordinals: where a run starts, its first window, how many windows it spans, its first place in them."""
    runs: list[list] = [[] for _ in range(bins + 1)]
    used, base = np.zeros(bins + 1, np.int64), 0
    for combo, n in combos:
        for q in dict.fromkeys(combo):
            runs[q].append((used[q], base, n, combo.index(q)))
            used[q] += n * combo.count(q)
        base += n
    return [dict(zip(("at", "first", "span", "place"), np.array(r, np.int64).T.reshape(4, -1), strict=True)) for r in runs]


def pack(pieces: DataFrame, window: int = 4096, unit: int = 8, salts: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset: at most window tokens a sequence, offsets without gaps. salts: into how many tasks one
    length is spread at most; by default as many as shuffle partitions, within 64 and 2048, as the histogram is kept per salt."""
    if window % unit:
        raise ValueError("window must be a multiple of unit")
    salts = salts or min(2048, max(64, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bins = window // unit
    salted = pieces.withColumn("bin", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    grid = np.zeros((bins + 1, salts), np.int64)
    for r in salted.groupBy("bin", "salt").count().toLocalIterator():  # bins x salts rows at most
        grid[r["bin"], r["salt"]] = r["count"]
    runs = lookup(plan(grid.sum(1)), bins)
    before = np.cumsum(grid, axis=1) - grid
    names = pieces.columns
    schema = pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("place")).schema

    def place(frames):
        for f in frames:
            q, s = f["bin"].to_numpy(), f["salt"].to_numpy()
            ordinal = f["ordinal"].to_numpy(np.int64) - 1 + before[q, s]
            seq, at = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for b in np.unique(q):
                mine, r = q == b, runs[b]
                i = np.searchsorted(r["at"], ordinal[mine], "right") - 1
                k = ordinal[mine] - r["at"][i]
                seq[mine], at[mine] = r["first"][i] + k % r["span"][i], r["place"][i] + k // r["span"][i]
            yield pd.concat([f[names], pd.DataFrame({"sequence_id": seq, "place": at}, index=f.index)], axis=1)

    numbered = salted.withColumn("ordinal", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("doc_id", "start")))
    placed = numbered.mapInPandas(place, schema)
    before_it = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(before_it), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, unit: int = 8) -> DataFrame:
    """Tokenize, cut and pack: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with small_batches(docs.sparkSession, BATCH):
        pieces, _ = write_table(token_pieces(docs, tokenizer_path, window, end_id), "pieces")
    return pack(pieces, window, unit)
