"""A small FLAC encoder for tests: every kind of subframe and layout, chosen by the caller."""

import hashlib

import numpy as np


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits.append(format(int(value) & ((1 << width) - 1), f"0{width}b") if width else "")

    def unary(self, n):
        self.bits.append("0" * int(n) + "1")

    def rice(self, values, k):
        for v in values:
            u = (int(v) << 1) ^ (int(v) >> 63)
            self.unary(u >> k)
            self.put(u, k)

    def bytes(self):
        s = "".join(self.bits)
        s += "0" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big") if s else b""


def residual(w, r, n, order, split=0, k=3, method=0, escape=None):
    w.put(method, 2)
    w.put(split, 4)
    at = 0
    for i in range(1 << split):
        many = (n >> split) - (order if i == 0 else 0)
        if escape == i:
            w.put((1 << (4 + method)) - 1, 4 + method)
            w.put(20, 5)
            for v in r[at : at + many]:
                w.put(v, 20)
        else:
            w.put(k, 4 + method)
            w.rice(r[at : at + many], k)
        at += many


def subframe(w, x, depth, kind, wasted=0, **coding):
    n = len(x)
    w.put(0, 1)
    code = {"constant": 0, "verbatim": 1}.get(kind[0]) if kind[0] in ("constant", "verbatim") else 8 + kind[1] if kind[0] == "fixed" else 31 + len(kind[1])
    w.put(code, 6)
    w.put(bool(wasted), 1)
    if wasted:
        w.unary(wasted - 1)
    x, depth = np.asarray(x) >> wasted, depth - wasted
    if kind[0] == "constant":
        w.put(x[0], depth)
    elif kind[0] == "verbatim":
        for v in x:
            w.put(v, depth)
    elif kind[0] == "fixed":
        order = kind[1]
        for v in x[:order]:
            w.put(v, depth)
        residual(w, np.diff(x, order), n, order, **coding)
    else:
        weights, shift = kind[1], kind[2]
        order = len(weights)
        for v in x[:order]:
            w.put(v, depth)
        w.put(11, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c, 12)
        r = [int(x[i]) - (sum(c * int(x[i - 1 - j]) for j, c in enumerate(weights)) >> shift) for i in range(order, n)]
        residual(w, r, n, order, **coding)


def encode(channels, rate=16_000, depth=16, block=256, layout=None, kinds=(("fixed", 2),), digest=True, wasted=0, **coding):
    """``layout`` 8, 9 or 10 codes two channels as left and side, side and right, middle and side."""
    channels = np.asarray(channels, np.int64)
    many, total = channels.shape
    width = -(-depth // 8)
    raw = channels.T.copy().astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (many - 1) << 41 | (depth - 1) << 36 | total).to_bytes(8, "big") + (hashlib.md5(raw).digest() if digest else bytes(16))
    out = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x81]) + (5).to_bytes(3, "big") + bytes(5)
    for number, at in enumerate(range(0, total, block)):
        x = channels[:, at : at + block]
        n = x.shape[1]
        w = Writer()
        for value, bits in ((0x3FFE, 14), (0, 2), (7, 4), (0, 4), (many - 1 if layout is None else layout, 4), (0, 3), (0, 1)):
            w.put(value, bits)
        if number < 128:
            w.put(number, 8)
        else:
            w.put(0xC0 | number >> 6, 8)
            w.put(0x80 | number & 63, 8)
        w.put(n - 1, 16)
        w.put(0, 8)
        depths = [depth] * many
        if layout == 8:
            x, depths = [x[0], x[0] - x[1]], [depth, depth + 1]
        elif layout == 9:
            x, depths = [x[0] - x[1], x[1]], [depth + 1, depth]
        elif layout == 10:
            x, depths = [(x[0] + x[1]) >> 1, x[0] - x[1]], [depth, depth + 1]
        for i, (c, d) in enumerate(zip(x, depths, strict=True)):
            kind = kinds[(number + i) % len(kinds)]
            subframe(w, c, d, kind if n > 40 else ("verbatim",), wasted, **(coding if kind[0] in ("fixed", "lpc") and n > 40 and n % (1 << coding.get("split", 0)) == 0 else {}))
        out += w.bytes() + bytes(2)
    return out
