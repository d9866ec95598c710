"""Any FLAC stream, frame by frame: all block sizes, rates, sample sizes up to 32 bits and channel assignments, wasted bits, Rice
codes of both widths and unencoded partitions.

Frames are found by walking their headers, so a seek table may be missing or sparse. CRC-8, CRC-16 and, where the stream has one,
the MD5 of its samples are verified; whatever is broken or reserved raises ValueError. Bits are read one field after another;
flac reads its own streams many frames at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .flac import FIXED, crc8, crc16

#: Fixed values of the format: samples of a frame by code (6 and 7: given in 8 or 16 bits), and bits of a sample by code.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


class Bits:
    """Fields of a byte string, the most significant bit first."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, 8 * at

    def take(self, n: int) -> int:
        if self.at + n > 8 * len(self.raw):
            raise ValueError("a stream ends early")
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.raw[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self) -> int:
        """How many zeros stand before the next one, which is taken too."""
        n = 0
        while True:
            rest = 8 - (self.at & 7)
            byte = self.take(rest)
            if byte:
                self.at -= byte.bit_length() - 1
                return n + rest - byte.bit_length()
            n += rest

    def number(self) -> int:
        """A frame's or sample's number: one to seven bytes, led by as many ones."""
        first = self.take(8)
        more = 0
        while first & (0x80 >> more):
            more += 1
        if more in (1, 8):
            raise ValueError("wrong number of a frame")
        value = first & (0x7F >> more)
        for _ in range(more - 1):
            value = value << 6 | self.take(8) & 0x3F
        return value


def _residual(bits: Bits, order: int, n: int) -> list[int]:
    method = bits.take(2)
    if method > 1:
        raise ValueError("reserved coding of residuals")
    width = 4 + method
    parts = 1 << bits.take(4)
    if n % parts or n // parts < order:
        raise ValueError("partitions don't fit a frame")
    out: list[int] = []
    for p in range(parts):
        rice, many = bits.take(width), n // parts - (order if p == 0 else 0)
        if rice == (1 << width) - 1:  # unencoded
            size = bits.take(5)
            out += [bits.signed(size) for _ in range(many)]
            continue
        for _ in range(many):
            u = bits.zeros() << rice | bits.take(rice)
            out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(bits: Bits, n: int, size: int) -> np.ndarray:
    """n samples of size bits."""
    if bits.take(1):
        raise ValueError("wrong padding of a subframe")
    kind = bits.take(6)
    wasted = bits.zeros() + 1 if bits.take(1) else 0
    size -= wasted
    if size < 1:
        raise ValueError("more wasted bits than a sample has")
    if kind == 0:
        x = [bits.signed(size)] * n
    elif kind == 1:
        x = [bits.signed(size) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > n:
            raise ValueError("a predictor is longer than its frame")
        x = [bits.signed(size) for _ in range(order)]
        weights, shift = FIXED.get(order, []), 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("wrong precision of a predictor")
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, order, n):
            x.append(r + (sum(w * v for w, v in zip(weights, reversed(x[len(x) - order :]), strict=True)) >> shift))
    else:
        raise ValueError("reserved kind of subframe")
    return np.array(x, np.int64) << wasted


def read(stream: bytes) -> tuple[dict, list[tuple[int, np.ndarray]]]:
    """What the stream says of itself, and its frames: first sample and (samples x channels)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info = 4, False, b""
    while not last:
        if at + 4 > len(stream):
            raise ValueError("metadata ends early")
        last, kind, size = stream[at] >> 7 == 1, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        info = stream[at + 4 : at + 4 + size] if kind == 0 else info
        at += 4 + size
    if len(info) < 34:
        raise ValueError("no stream information")
    packed, usual = int.from_bytes(info[10:18], "big"), int.from_bytes(info[:2], "big")
    about = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (2**36 - 1), "md5": info[18:34]}
    frames = []
    while at < len(stream):
        bits = Bits(stream, at)
        if bits.take(14) != 0x3FFE or bits.take(1):
            raise ValueError("no frame where one should begin")
        apart = bits.take(1)
        block, rate, channel, size = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        if bits.take(1) or block == 0 or rate == 15 or channel > MID_SIDE or size == 3:
            raise ValueError("reserved code in a frame's header")
        number = bits.number()
        n = bits.take(8 * (block - 5)) + 1 if block in (6, 7) else BLOCK_SIZES[block]
        bits.take(8 if rate == 12 else 16 if rate in (13, 14) else 0)
        if crc8(stream[at : bits.at >> 3]) != bits.take(8):
            raise ValueError("wrong checksum of a frame's header")
        width, many = SAMPLE_BITS.get(size, about["bits"]), channel + 1 if channel < LEFT_SIDE else 2
        side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(channel)
        x = [_subframe(bits, n, width + (c == side)) for c in range(many)]
        bits.take(-bits.at % 8)
        if crc16([stream[at : bits.at >> 3]])[0] != bits.take(16):
            raise ValueError("wrong checksum of a frame")
        if channel == LEFT_SIDE:
            x[1] = x[0] - x[1]
        elif channel == SIDE_RIGHT:
            x[0] = x[0] + x[1]
        elif channel == MID_SIDE:
            middle = x[0] * 2 | x[1] & 1
            x = [(middle + x[1]) >> 1, (middle - x[1]) >> 1]
        frames.append((number if apart else number * usual, np.stack(x, 1)))
        at = bits.at >> 3
    got = sum(len(x) for _, x in frames)
    if about["samples"] and got != about["samples"]:
        raise ValueError("samples are missing")
    if any(about["md5"]) and hashlib.md5(b"".join(pcm(x, about["bits"]) for _, x in frames)).digest() != about["md5"]:
        raise ValueError("decoded samples differ from the encoded ones")
    return about, frames


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Samples as little-endian signed numbers of whole bytes, channels in turn."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
