"""FLAC to samples in numpy, after the published format (RFC 9639).

Rice codes are found by following the one-bits of a frame: where each code's
unary part ends tells where the next one begins, and all values are then cut
out at once.  The whole clip is checked against the digest in its header.
"""

from __future__ import annotations

import hashlib
from operator import mul

import numpy as np

_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Bits of the unary part that a window of a frame allows for beyond its samples.
_SLACK = 1 << 14


class _Bits:
    """Reads bits of ``data`` from a byte on; ``need`` unpacks as many as a step may take."""

    def __init__(self, data: np.ndarray, byte: int):
        self.data, self.base, self.at = data, byte, 0
        self.bits = np.zeros(0, np.uint8)
        self.ends: list[int] = []

    def need(self, many: int) -> None:
        """Unpacks more if fewer than ``many`` bits are left of what is unpacked."""
        if len(self.bits) - self.at >= many:
            return
        skip = self.at // 8
        self.base, self.at = self.base + skip, self.at - 8 * skip
        stop = self.base + (self.at + many) // 8 + 8
        self.bits = np.unpackbits(self.data[self.base : stop])
        ones = np.where(self.bits, np.arange(len(self.bits)), len(self.bits))
        self.ends = np.minimum.accumulate(ones[::-1])[::-1].tolist() if len(ones) else []  # the next one-bit from each place

    def take(self, many: int) -> int:
        """An unsigned number of ``many`` bits."""
        self.need(many)
        piece = self.bits[self.at : self.at + many]
        if len(piece) < many:
            raise ValueError("the stream ends early")
        self.at += many
        return int.from_bytes(np.packbits(np.concatenate([np.zeros(-many % 8, np.uint8), piece])).tobytes(), "big") if many else 0

    def signed(self, many: int) -> int:
        x = self.take(many)
        return x - (1 << many) if many and x >> (many - 1) else x

    def numbers(self, many: int, width: int) -> np.ndarray:
        """Signed numbers of ``width`` bits each."""
        self.need(many * width)
        if len(self.bits) - self.at < many * width:
            raise ValueError("the stream ends early")
        found = _values(self.bits, self.at + width * np.arange(many), width)
        self.at += many * width
        return found - ((found >> max(0, width - 1)) << width) if width else found

    def unary(self) -> int:
        self.need(_SLACK)
        end = self.ends[self.at]
        if end >= len(self.bits):
            raise ValueError("the stream ends early")
        zeros, self.at = end - self.at, end + 1
        return zeros

    def rice(self, many: int, width: int) -> np.ndarray:
        """Rice-coded signed numbers with ``width`` low bits."""
        parts, slack = [], _SLACK
        while many:
            self.need(many * (width + 1) + slack)
            ends, at, limit, starts, stops = self.ends, self.at, len(self.bits) - width, [], []
            for _ in range(many):
                if at >= limit or (stop := ends[at]) >= limit:
                    break
                starts.append(at)
                stops.append(stop)
                at = stop + 1 + width
            if not starts:
                if self.base + len(self.bits) // 8 >= len(self.data):
                    raise ValueError("the stream ends early")
                slack *= 4  # one code is longer than what is unpacked
                continue
            stop = np.array(stops)
            folded = (stop - np.array(starts)) << width | _values(self.bits, stop + 1, width)
            parts.append(folded >> 1 ^ -(folded & 1))
            self.at, many = at, many - len(starts)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _values(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for j in range(width):
        out = out << 1 | bits[at + j]
    return out


def _residual(b: _Bits, n: int, order: int) -> np.ndarray:
    method = b.take(2)
    if method > 1:
        raise ValueError("unknown coding of residuals")
    size = 4 + method
    split = b.take(4)
    if n % (1 << split) or n >> split < order:
        raise ValueError("bad partitions of residuals")
    parts = []
    for i in range(1 << split):
        many = (n >> split) - (order if i == 0 else 0)
        width = b.take(size)
        parts.append(b.numbers(many, b.take(5)) if width == (1 << size) - 1 else b.rice(many, width))
    return np.concatenate(parts)


def _subframe(b: _Bits, n: int, depth: int) -> np.ndarray:
    b.need(8)
    if b.take(1):
        raise ValueError("bad subframe")
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(n, b.signed(depth), np.int64)
    elif kind == 1:
        out = b.numbers(n, depth)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = b.numbers(order, depth)
        out = _residual(b, n, order)
        for k in range(order, 0, -1):  # the k-th differences, from their first value on, sum up to the ones before
            out = np.cumsum(np.concatenate([np.diff(first[:k], k - 1), out]))
    elif kind >= 32:
        order = kind - 31
        samples = b.numbers(order, depth).tolist()
        width = b.take(4) + 1
        if width == 16:
            raise ValueError("bad precision of a predictor")
        shift = b.signed(5)
        weights = b.numbers(order, width).tolist()[::-1]
        for r in _residual(b, n, order).tolist():
            samples.append(r + (sum(map(mul, weights, samples[-order:])) >> shift))
        out = np.array(samples, np.int64)
    else:
        raise ValueError("unknown kind of subframe")
    return out << wasted


def _frame(data: np.ndarray, byte: int, rate: int, depth: int) -> tuple[list[np.ndarray], int]:
    """The channels of the frame at a byte, and where the next one begins."""
    b = _Bits(data, byte)
    if b.take(14) != 0x3FFE or b.take(1):
        raise ValueError("no frame where one should be")
    b.take(1)
    size, speed, layout, bits = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)  # the frame's number, coded as UTF-8 codes characters
    for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1)):
        b.take(8)
    n = 192 if size == 1 else 576 << (size - 2) if 2 <= size <= 5 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << (size - 8)
    if speed >= 12:
        b.take(8 if speed == 12 else 16)
    if size == 0 or speed == 15 or (speed in _RATES and _RATES[speed] != rate):
        raise ValueError("bad frame header")
    b.take(8)
    depth = _DEPTHS.get(bits, depth)
    if layout > 10:
        raise ValueError("bad layout of channels")
    channels = []
    for i in range(layout + 1 if layout < 8 else 2):
        b.need(n * 2 + _SLACK)
        channels.append(_subframe(b, n, depth + ((layout, i) in ((8, 1), (9, 0), (10, 1)))))
    if layout == 8:
        channels[1] = channels[0] - channels[1]
    elif layout == 9:
        channels[0] = channels[0] + channels[1]
    elif layout == 10:
        middle, side = channels[0] << 1 | channels[1] & 1, channels[1]
        channels = [(middle + side) >> 1, (middle - side) >> 1]
    return channels, b.base + -(-b.at // 8) + 2


def decode_flac(content: bytes) -> tuple[np.ndarray, int]:
    """Mono doubles in -1..1 and the sample rate; ValueError for a broken stream."""
    if content[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, last = 4, b"", False
    while not last:
        head = content[at : at + 4]
        if len(head) < 4:
            raise ValueError("the stream ends early")
        last, kind, size = bool(head[0] & 0x80), head[0] & 0x7F, int.from_bytes(head[1:], "big")
        if kind == 0:
            info = content[at + 4 : at + 4 + size]
        at += 4 + size
    if len(info) < 34:
        raise ValueError("no stream header")
    packed = int.from_bytes(info[10:18], "big")
    rate, many, depth, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
    data = np.frombuffer(content, np.uint8)
    parts: list[np.ndarray] = []
    done = 0
    while at < len(content) and (not total or done < total):
        channels, at = _frame(data, at, rate, depth)
        if len(channels) != many:
            raise ValueError("the number of channels changes")
        parts.append(np.stack(channels, axis=1))
        done += len(channels[0])
    samples = np.concatenate(parts) if parts else np.zeros((0, many), np.int64)
    if total and done != total:
        raise ValueError("the stream ends early")
    width = -(-depth // 8)
    raw = samples.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    if any(info[18:34]) and hashlib.md5(raw).digest() != info[18:34]:
        raise ValueError("the samples do not match their digest")
    return samples.mean(axis=1) / (1 << (depth - 1)) if len(samples) else np.zeros(0), rate
