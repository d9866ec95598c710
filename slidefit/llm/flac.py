"""FLAC columns: an encoder and a decoder of mono 8-bit streams that work on many frames at once.

Encoding tries fixed predictors of order 0 to 4 and a linear predictor of order 4 (autocorrelation, Levinson recursion,
quantised coefficients) for every frame, Rice-codes the residual of the best, and stores samples verbatim where that is
smaller. Each frame has a seek point, so blocks can be read apart. Decoding walks all frames of a batch in step: the n-th
residual of every frame is read by one set of vector operations (leading zeros by table, remainder by shifts) and added to
its prediction. Header (CRC-8) and frame (CRC-16) checksums and the stream's MD5 are verified; a mismatch raises.

Samples are bytes minus 128. Payloads are padded with zero bytes to a positive multiple of 64, so every frame has 64
samples at least. Null texts count as empty. Batches are cut by bytes, so memory doesn't grow with the number of rows; a
text, however long, must fit into a task's memory. Repeated rows are coded each, rows without an id keep a null one; further
columns are left behind; an empty table gives an empty result. flac_reader reads the streams of other encoders.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, FRAME, RATE = 64, 512, 8000
#: Bytes of payload coded at a time.
BATCH = 1 << 20
#: Fixed predictors of the format: weights of the samples before, nearest first.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
ORDER, PRECISION, SHIFT = 4, 12, 10


def _crc_table(width: int, polynomial: int, steps: int) -> np.ndarray:
    c = np.arange(1 << steps, dtype=np.uint32) << (width - steps)
    for _ in range(steps):
        c = np.where(c >> (width - 1) & 1, (c << 1) ^ polynomial, c << 1) & ((1 << width) - 1)
    return c


_CRC8 = _crc_table(8, 0x07, 8).tolist()
_CRC16 = _crc_table(16, 0x8005, 16).astype(np.uint16)
_ZEROS = np.array([16 - int(v).bit_length() for v in range(1 << 16)], np.uint8)


def crc8(b: bytes) -> int:
    c = 0
    for x in b:
        c = _CRC8[c ^ x]
    return c


def crc16(frames: list[bytes]) -> np.ndarray:
    """Checksums of many frames in step, two bytes at a time; zero bytes in front change nothing."""
    longest = max(map(len, frames))
    longest += longest % 2
    m = np.zeros((len(frames), longest), np.uint8)
    for row, f in zip(m, frames, strict=True):
        row[longest - len(f) :] = np.frombuffer(f, np.uint8)
    c = np.zeros(len(frames), np.uint16)
    for w in np.ascontiguousarray(m.view(">u2").T.astype(np.uint16)):
        c = _CRC16[c ^ w]
    return c


def _number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size) | n) & 0xFF, *tail[::-1]])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised order-4 weights of each frame and their residuals from sample 4 on."""
    f = x.astype(np.float32)
    f -= f.mean(1, keepdims=True)
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : x.shape[1] - k]) for k in range(ORDER + 1)], 1).astype(float)
    error, a = r[:, 0] * 1.0001 + 1e-3, np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = error * np.maximum(1 - k * k, 1e-6)
    q = np.clip(np.rint(a * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)
    guess = sum(q[:, j : j + 1] * x[:, ORDER - 1 - j : x.shape[1] - 1 - j] for j in range(ORDER))
    return q, x[:, ORDER:] - (guess >> SHIFT)


def _pack(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Rows of fields as bit strings padded to bytes; a field's value fills its last bits (32 at most), zeros come before."""
    ends = np.cumsum(sizes, 1, dtype=np.int64)
    words = (ends[:, -1] + 31) // 32 + 1
    base = np.cumsum(words) - words
    last = ends - 1
    word, shift = base[:, None] + 1 + last // 32, (31 - last % 32).astype(np.uint64)
    v = values.astype(np.uint64) << shift
    total = int(words.sum()) + 1
    # fields don't overlap, so adding is setting
    out = np.bincount(word.ravel(), (v & np.uint64(0xFFFFFFFF)).ravel().astype(float), total)
    out += np.bincount(word.ravel() - 1, (v >> np.uint64(32)).ravel().astype(float), total)
    raw = out.astype(">u4").tobytes()
    return [raw[4 * (b + 1) : 4 * (b + 1) + (n + 7) // 8] for b, n in zip(base.tolist(), ends[:, -1].tolist(), strict=True)]


def _bodies(x: np.ndarray) -> list[bytes]:
    """Subframes of equally long frames, the rows of x."""
    n, size = x.shape
    residuals = {0: x}
    for k in range(1, 5):
        residuals[k] = np.diff(residuals[k - 1], axis=1)
    q, residuals[5] = _linear(x)
    cost = np.stack([np.abs(residuals[k][:, (4 - k) if k < 5 else 0 :]).sum(1, dtype=np.int64) for k in range(6)], 1)
    cost[:, 5] += 3 * PRECISION * ORDER // 2  # its weights take room too
    best, out = cost.argmin(1), [b""] * n
    flat = (x == x[:, :1]).all(1)
    best[flat] = -1
    for at in np.flatnonzero(flat):
        out[at] = bytes([0, int(x[at, 0]) & 0xFF])
    for k in range(6):
        rows = np.flatnonzero(best == k)
        if not len(rows):
            continue
        order = k if k < 5 else ORDER
        u = _zigzag(residuals[k][rows])
        mean = np.maximum(u.mean(1), 1e-9)
        first = np.clip(np.floor(np.log2(mean)).astype(int) - 1, 0, 11)
        tries = np.stack([u.shape[1] * (first + d + 1) + (u >> (first + d)[:, None]).sum(1, dtype=np.int64) for d in range(3)], 1)
        rice, bits = first + tries.argmin(1), tries.min(1)
        head = [(np.full(len(rows), 8 + order if k < 5 else 32 + ORDER - 1) << 1, 8)]
        head += [(x[rows, j] & 0xFF, 8) for j in range(order)]
        if k == 5:
            head += [(np.full(len(rows), PRECISION - 1), 4), (np.full(len(rows), SHIFT), 5)] + [(q[rows, j] & ((1 << PRECISION) - 1), PRECISION) for j in range(ORDER)]
        head += [(np.zeros(len(rows), int), 6), (rice, 4)]
        whole = bits + sum(s for _, s in head)
        small = whole < 8 * (size + 1)
        for at in rows[~small]:
            out[at] = b"\x02" + (x[at] & 0xFF).astype(np.uint8).tobytes()
        if small.any():
            u, rice = u[small], rice[small][:, None]
            values = np.concatenate([np.stack([v[small] for v, _ in head], 1), (1 << rice) | (u & ((1 << rice) - 1))], 1)
            sizes = np.concatenate([np.tile([s for _, s in head], (len(u), 1)), (u >> rice) + 1 + rice], 1)
            for at, b in zip(rows[small], _pack(values, sizes), strict=True):
                out[at] = b
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for every payload; payloads have a positive multiple of 64 bytes."""
    cuts = [(p, k, min(FRAME, len(b) - k)) for p, b in enumerate(payloads) for k in range(0, len(b), FRAME)]
    bodies: list[bytes] = [b""] * len(cuts)
    by_size: dict[int, list[int]] = {}
    for at, (_, _, size) in enumerate(cuts):
        by_size.setdefault(size, []).append(at)
    for size, rows in by_size.items():
        joined = b"".join([payloads[cuts[at][0]][cuts[at][1] : cuts[at][1] + size] for at in rows])
        x = np.frombuffer(joined, np.uint8).reshape(-1, size).astype(np.int32) - 128
        for at, b in zip(rows, _bodies(x), strict=True):
            bodies[at] = b
    frames = []
    for (_, k, size), body in zip(cuts, bodies, strict=True):
        head = b"\xff\xf8\x70\x02" + _number(k // FRAME) + struct.pack(">H", size - 1)
        frames.append(head + bytes([crc8(head)]) + body)
    sums = crc16(frames).tolist() if frames else []
    own: list[list[tuple[int, int, bytes]]] = [[] for _ in payloads]
    for (p, k, size), f, c in zip(cuts, frames, sums, strict=True):
        own[p].append((k, size, f + struct.pack(">H", c)))
    return [_stream(b, rows) for b, rows in zip(payloads, own, strict=True)]


def _stream(payload: bytes, frames: list[tuple[int, int, bytes]]) -> bytes:
    sizes = [len(f) for _, _, f in frames]
    samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()  # signed 8-bit samples
    info = struct.pack(">HH", FRAME, FRAME) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    points, at = [], 0
    for k, n, f in frames:
        points.append(struct.pack(">QQH", k, at, n))
        at += len(f)
    table = b"".join(points)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(f for _, _, f in frames)


def parse(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int, int]]]:
    """Samples, MD5, and of each frame: first sample, samples, first byte, end byte."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, points, info = 4, False, b"", b""
    while not last:
        if at + 4 > len(stream):
            raise ValueError("metadata ends early")
        kind, size = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        last = stream[at] >> 7 == 1
        if kind == 0:
            info = stream[at + 4 : at + 4 + size]
        elif kind == 3:
            points = stream[at + 4 : at + 4 + size]
        at += 4 + size
    if len(info) < 34:
        raise ValueError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or packed >> 36 & 31 != 7:
        raise ValueError("only mono streams of 8 bits")
    seek = [p for p in struct.iter_unpack(">QQH", points) if p[0] != 2**64 - 1]
    ends = [p[1] for p in seek[1:]] + [len(stream) - at]
    return packed & (2**36 - 1), info[18:34], [(k, n, at + a, at + e) for (k, a, n), e in zip(seek, ends, strict=True)]


def _header(frame: bytes) -> tuple[int, int]:
    """Samples of a frame and where its subframe begins; verifies the header."""
    if frame[:2] != b"\xff\xf8" or frame[2] != 0x70 or frame[3] != 0x02:
        raise ValueError("frame header of another kind")
    size = 1
    while frame[4] & (0x80 >> size) and frame[4] & 0x80:
        size += 1
    at = 4 + size + 2
    if crc8(frame[:at]) != frame[at]:
        raise ValueError("wrong checksum of a frame's header")
    return struct.unpack(">H", frame[4 + size : at])[0] + 1, at + 1


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame; all frames are decoded in step."""
    if not frames:
        return []
    stored = np.array([f[-2] << 8 | f[-1] for f in frames])
    if (crc16([f[:-2] for f in frames]) != stored).any():
        raise ValueError("wrong checksum of a frame")
    out: list = [None] * len(frames)
    groups: dict[int, list[tuple[int, int]]] = {}
    for at, f in enumerate(frames):
        n, body = _header(f)
        kind = f[body] >> 1
        if kind == 0:
            out[at] = np.full(n, np.int8(np.uint8(f[body + 1])), np.int32)
        elif kind == 1:
            out[at] = np.frombuffer(f, np.int8, n, body + 1).astype(np.int32)
        elif 8 <= kind <= 12 or kind >= 32:
            groups.setdefault(n, []).append((at, body))
        else:
            raise ValueError("reserved kind of subframe")
    for n, rows in groups.items():
        for (at, _), x in zip(rows, _predicted([frames[at][body:-2] for at, body in rows], n), strict=True):
            out[at] = x
    return out


def _predicted(bodies: list[bytes], n: int) -> np.ndarray:
    """Samples (frames x n) of subframes with fixed or linear predictors."""
    sizes = np.array([len(b) for b in bodies])
    raw = np.frombuffer(b"".join(bodies) + bytes(16), np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (len(raw) - 8, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    pos = 8 * (np.cumsum(sizes) - sizes)
    end = pos + 8 * sizes

    def take(bits: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        w = words[pos[of] >> 3] << (pos[of] & 7).astype(np.uint64)
        pos[of] += bits
        return (w >> np.uint64(64 - bits)).astype(np.int64)

    kind = take(8) >> 1
    order = np.where(kind < 32, kind - 8, kind - 31)
    top = int(order.max())
    x = np.zeros((n, len(bodies)), np.int64)
    for i in range(top):
        of = np.flatnonzero(order > i)
        v = take(8, of)
        x[i, of] = np.where(v > 127, v - 256, v)
    weights, shift = np.zeros((top, len(bodies)), np.int64), np.zeros(len(bodies), np.int64)
    for k, w in list(FIXED.items())[: top + 1]:
        weights[: len(w), (kind == 8 + k)] = np.array(w, np.int64)[:, None]
    lpc = np.flatnonzero(kind >= 32)
    if len(lpc):
        precision = take(4, lpc) + 1
        shift[lpc] = take(5, lpc)
        for i in range(int(order[lpc].max())):
            for p in np.unique(precision):
                of = lpc[(order[lpc] > i) & (precision == p)]
                v = take(int(p), of)
                weights[i, of] = np.where(v >> (p - 1) & 1, v - (1 << p), v)
    if take(2).any():
        raise ValueError("only residuals with 4-bit parameters")
    part = n >> take(4)
    rice, one = np.zeros(len(bodies), np.int64), np.uint64(1)
    least, whole = int(order.min()), bool((part == n).all())
    for i in range(least, n):
        if i < top or not whole:
            on = order <= i
            new = np.flatnonzero(on & ((order == i) | (i % part == 0)))
        else:
            on, new = None, (np.flatnonzero(order == i) if i == top else ())
        if len(new):
            rice[new] = take(4, new)
            if (rice[new] == 15).any():
                raise ValueError("unencoded residuals aren't supported")
        w = words[pos >> 3] << (pos & 7).astype(np.uint64)
        zeros = _ZEROS[(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        long_ = np.flatnonzero(zeros == 16) if on is None else np.flatnonzero((zeros == 16) & on)
        for f in long_:  # a longer run of zeros: bit by bytes
            at = int(pos[f])
            while at < end[f] and not raw[at >> 3] >> (7 - (at & 7)) & 1:
                at += 1
            zeros[f] = at - pos[f]
        if len(long_):
            behind = pos + zeros
            w = words[np.minimum(behind, end) >> 3] << (behind & 7).astype(np.uint64) << one
        else:
            w = w << (zeros + 1).astype(np.uint64)
        u = zeros << rice | ((w >> one) >> (63 - rice).astype(np.uint64)).astype(np.int64)
        value = (u >> 1) ^ -(u & 1)
        step = zeros + 1 + rice
        if top:
            guess = weights[0] * x[i - 1] if i else np.zeros(len(bodies), np.int64)
            for j in range(1, min(top, i)):
                guess += weights[j] * x[i - 1 - j]
            value += guess >> shift
        if on is None:
            x[i] = value
            pos += step
        else:
            x[i, on] = value[on]
            pos[on] += step[on]
    if (pos > end).any():
        raise ValueError("a frame ends early")
    return x.T


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of each stream: first sample and 8-bit samples as the payload's bytes; verifies checksums and MD5."""
    heads = [parse(s) for s in streams]
    frames = decode_frames([s[a:e] for s, (_, _, rows) in zip(streams, heads, strict=True) for _, _, a, e in rows])
    out, at = [], 0
    for total, md5, rows in heads:
        own, at = frames[at : at + len(rows)], at + len(rows)
        samples = np.concatenate(own).astype(np.int8)
        if len(samples) != total or hashlib.md5(samples.tobytes()).digest() != md5:
            raise ValueError("decoded samples differ from the encoded ones")
        raw = (samples.view(np.uint8) ^ 0x80).tobytes()
        out.append([(k, raw[k : k + n]) for k, n, _, _ in rows])
    return out


def decode_any(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """decode, but streams of other encoders too, one by one: mono 8-bit ones as a payload's bytes, others as little-endian PCM."""
    try:
        return decode(streams)
    except (ValueError, IndexError):
        from . import flac_reader

        out = []
        for s in streams:
            about, frames = flac_reader.read(s)
            plain = about["channels"] == 1 and about["bits"] == 8
            out.append([(k, (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes() if plain else flac_reader.pcm(x, about["bits"])) for k, x in frames])
        return out


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _batches(items: list[bytes]):
    at, size = 0, 0
    for k, b in enumerate(items):
        size += len(b)
        if size >= BATCH:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(items):
        yield at, len(items)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (a FLAC stream). Nothing is shuffled."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _batches(texts):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(encode([payload_of(t) for t in texts[i:j]]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, pcm: decoded blocks that can be sought by sample; any FLAC stream is read, null media have none."""

    def run(batches):
        for b in batches:
            ids, streams = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _batches(streams):
                rows = [(d, k, p) for d, blocks in zip(ids[i:j], decode_any(streams[i:j]), strict=True) for k, p in blocks]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "sample_offset", "pcm"])

    return media.where("media is not null").select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, pcm binary")


def feature_of(payload: bytes) -> str:
    """Whole numbers that describe the samples: count, mean size, crossings of zero, peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    return f"n={len(x)} abs={int(np.abs(x).sum()) * 1000 // len(x)} cross={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))} peak={int(np.abs(x).max())}"


def described(media: DataFrame) -> DataFrame:
    """Per stream: digests and features of what its stored bytes decode to."""
    fields = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches):
        for b in batches:
            ids, sizes, streams = (b.column(k).to_pylist() for k in range(3))
            for i, j in _batches(streams):
                rows = []
                for d, n, s, blocks in zip(ids[i:j], sizes[i:j], streams[i:j], decode(streams[i:j]), strict=True):
                    p = b"".join(x for _, x in blocks)
                    rows.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), feature_of(p)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in fields.items()))
