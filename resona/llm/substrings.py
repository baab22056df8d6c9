"""Exact-substring removal over a sparse, distributed suffix array.

A text is a string of units: its bytes, or its words.  Every unit covered by a
string of ``length`` units that also starts elsewhere is found exactly, without
sorting a suffix for each unit of the corpus:

1. Windows of ``length`` units choose an anchor: the window's least gram of
   ``gram`` units by a mixed hash, the rightmost among equals.  The choice
   depends on the window's units alone, so equal windows have equal anchors at
   equal places.  Consecutive windows mostly share an anchor; the run of windows
   of one anchor occurrence covers one span of units.  Where a text repeats a
   short string over and over, its equal spans follow each other and are one row.
2. Spans that occur twice settle all of their windows at once.  An anchor gram
   that occurs once settles its windows too: they are unique.
3. What is left are grams that repeat within spans that differ, at the edges of
   shared passages.  Their window suffixes form the sparse suffix array:
   sampled splitters range-partition them by leading token (eight bytes, then
   the rest's fingerprint), each bucket sorts locally by multikey quicksort over these
   symbols, and buckets compare their first and last keys across boundaries,
   so a string that fills several buckets needs no single task.

Equality of spans and windows is decided on 128 bits.  Texts are hashed piece by
piece, so that a text of any length takes a bounded multiple of its own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, drop_path, lean, partitions, release, scratch, text_key, whole_text

#: Bytes of a string whose repeats are removed, and of an anchor gram.
LENGTH, GRAM = 400, 200
#: Words of a passage whose repeats are removed, and of an anchor gram.
WORDS, WORD_GRAM = 50, 20
#: Windows that are hashed at once; longer texts go piece by piece.
PIECE = 1 << 18
#: Suffixes that a bucket holds on average at most.
BUCKET = 1 << 21

_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x = x * _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of any substring of a piece, from prefix sums modulo 2**64.

    Units enter through a nonlinear code, as plain polynomials modulo a power
    of two have known collisions on structured inputs.  The bases are odd, so
    multiplying by base**-start makes hashes comparable wherever they stand.
    """

    _power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    _inverse = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, codes: np.ndarray, which: int):
        n = len(codes)
        if len(Rolling._power[which]) <= n:  # grows to a piece, whatever the text
            base, size = int(_BASES[which]), max(1 << 12, 2 * n)
            Rolling._power[which], Rolling._inverse[which] = _powers(_U(base), size), _powers(_U(pow(base, -1, 1 << 64)), size)
        self.inverse = Rolling._inverse[which]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * Rolling._power[which][:n], out=self.sums[1:])

    def grams(self, start: int, many: int, gram: int) -> np.ndarray:
        """Hashes of the ``many`` grams from ``start`` on."""
        return _mix((self.sums[start + gram : start + gram + many] - self.sums[start : start + many]) * self.inverse[start : start + many])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the strings [start, end)."""
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _pair(a: Rolling, b: Rolling, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash from two independent ones."""
    return _mix(a.of(starts, ends) ^ (b.of(starts, ends) * _U(0x9E3779B97F4A7C15)))


class Bytes:
    """A text as a string of its bytes."""

    _table = [_mix(np.arange(256, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + s) for s in (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))]

    def __init__(self, text: bytes):
        self.data = np.frombuffer(text, np.uint8)

    def __len__(self) -> int:
        return len(self.data)

    def rolling(self, a: int, b: int) -> tuple[Rolling, Rolling]:
        """Two independent hashes of the units a..b."""
        return Rolling(Bytes._table[0][self.data[a:b]], 0), Rolling(Bytes._table[1][self.data[a:b]], 1)

    def lead(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each unit on, as a number in their order."""
        out = np.zeros(len(at), np.uint64)
        for j in range(8):
            out = out << _U(8) | self.data[at + j].astype(np.uint64)
        return out

    def extent(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text of the unit strings [a, b)."""
        return a, b


class Words:
    """A text as a string of its words: runs of bytes other than ASCII white space."""

    _space = np.isin(np.arange(256), list(b" \t\n\v\f\r"))

    def __init__(self, text: bytes):
        self.text = text
        self.data = np.frombuffer(text, np.uint8)
        space = np.concatenate([[True], Words._space[self.data], [True]])
        self.starts = np.flatnonzero(space[:-1] & ~space[1:])
        self.ends = np.flatnonzero(~space[:-1] & space[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def rolling(self, a: int, b: int) -> tuple[Rolling, Rolling]:
        own = self.text[self.starts[a] : self.ends[min(b, len(self)) - 1]].split() if a < min(b, len(self)) else []
        codes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, own)), np.uint64).reshape(-1, 2)
        return Rolling(codes[:, 0], 0), Rolling(codes[:, 1], 1)

    def lead(self, at: np.ndarray) -> np.ndarray:
        starts, ends, out = self.starts[at], self.ends[at], np.zeros(len(at), np.uint64)
        for j in range(8):
            there = starts + j < ends
            out = out << _U(8) | np.where(there, self.data[np.where(there, starts + j, 0)], 0).astype(np.uint64)
        return out

    def extent(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the first word to the next word that stays, or to the end."""
        return self.starts[a], np.append(self.starts, len(self.text))[b]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive keys."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


@dataclass
class Anchors:
    """The anchor occurrences of a text, equal ones in a row taken together."""

    grams: np.ndarray  # hash of the anchor's gram
    spans: np.ndarray  # hash of the span
    first: np.ndarray  # first and last window of the first occurrence
    last: np.ndarray
    reach: np.ndarray  # last window of the last one
    times: np.ndarray

    def runs(self) -> np.ndarray:
        """first, reach - last and last - first in one number each."""
        return self.first << 32 | (self.reach - self.last) << 16 | (self.last - self.first)


def anchors(units: Bytes | Words, length: int = LENGTH, gram: int = GRAM) -> Anchors:
    """Each anchor occurrence of a text."""
    windows, width = len(units) - length + 1, length - gram + 1
    low = _U((1 << 20) - 1)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, windows, PIECE):
        # a run has at most ``width`` windows: one window before the piece and ``width`` after it tell its runs' ends
        since, until = max(0, at - 1), min(windows, at + PIECE + width)
        a, b = units.rolling(since, until + length - 1)
        keys = a.grams(0, until - since + width - 1, gram) & ~low
        keys |= low - np.arange(len(keys), dtype=np.uint64)  # the rightmost among equals
        chosen = (low - (_least(keys, width) & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[since == at], chosen[1:] != chosen[:-1]]))
        last = np.append(first[1:], until - since) - 1
        own = since + first < at + PIECE
        first, last = first[own], last[own]
        place = chosen[first]
        found.append((a.of(place, place + gram), _pair(a, b, first, last + length) ^ (last - first).astype(np.uint64), since + first, since + last))
    grams, spans, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    n = len(grams)
    fresh = np.ones(n, bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (spans[1:] != spans[:-1])
    nth = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    heads = np.flatnonzero(nth % (0xFFFF // width) == 0)  # so that the reach fits its 16 bits
    ends = np.append(heads, n)[1:]
    return Anchors(grams[heads], spans[heads], first[heads], last[heads], last[ends - 1], ends - heads)


def _anchor_rows(kind: type, length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, k1, k2, copies = (batch.column(c) for c in ("text", "k1", "k2", "copies"))
            got: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                x = anchors(kind(texts[i].as_buffer().to_pybytes()), length, gram)
                m = len(x.grams)
                if not m:
                    continue
                columns = (x.grams.view(np.int64), x.spans.view(np.int64), np.full(m, k1[i].as_py()), np.full(m, k2[i].as_py()), x.runs(), np.minimum(2, x.times * copies[i].as_py()))
                for into, c in zip(got, columns, strict=True):
                    into.append(c)
            if got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in got], ["gram", "span", "k1", "k2", "run", "w"])

    return rows


def windows_of(units: Bytes | Words, run: np.ndarray, w: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lead, rest, weight, start) of the windows of the runs, piece by piece."""
    order = np.argsort(run, kind="stable")
    run, w = run[order], w[order]
    heads = run >> 32
    for at in range(0, len(units), PIECE):
        lo, hi = np.searchsorted(heads, [at, at + PIECE])
        if lo == hi:
            continue
        sizes = (run[lo:hi] & 0xFFFF) + 1
        starts = np.repeat(heads[lo:hi] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        a, b = units.rolling(at, min(len(units), int((heads[lo:hi] + sizes).max()) + length - 1))
        yield units.lead(starts), _pair(a, b, starts - at, starts - at + length), np.repeat(w[lo:hi] - 1, sizes), starts


def _window_rows(kind: type, length: int):
    """Texts with the runs to look at: a row (lead, rest, k1, place) for each window.

    place: k2's 32 bits above, 1 bit of the weight, 31 bits of the start.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, k1, k2, runs = (batch.column(c) for c in ("text", "k1", "k2", "runs"))
            at, (run, w) = _flat(runs, "run", "w")
            for i in range(batch.num_rows):
                own = slice(at[i], at[i + 1])
                for lead, rest, weight, starts in windows_of(kind(texts[i].as_buffer().to_pybytes()), run[own], w[own], length):
                    place = (_U(k2[i].as_py()) << _U(32) | (weight << 31 | starts).astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lead.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(np.full(len(starts), k1[i].as_py())), pa.array(place)],
                        ["lead", "rest", "k1", "place"],
                    )

    return rows


def _flat(lists: pa.ListArray, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of each row's list (null: empty) and the fields of all entries."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def multikey_order(symbols: list[np.ndarray]) -> np.ndarray:
    """The order that sorts rows of equal-length strings given symbol by symbol.

    Three-way radix quicksort: rows are sorted by the first symbol, and only
    runs of equal rows go on to the next one.
    """
    order = np.argsort(symbols[0], kind="quicksort")
    for depth in range(1, len(symbols)):
        same = np.ones(len(order), bool)
        for s in symbols[:depth]:
            v = s[order]
            same[1:] &= v[1:] == v[:-1]
        heads = np.flatnonzero(~same[1:]) + 1
        bounds = np.concatenate([[0], heads, [len(order)]])
        run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        tied = np.diff(bounds)[run] > 1
        at = np.flatnonzero(tied)
        if not len(at):
            break
        part = order[at]
        # runs keep their places: sort the tied rows by (run, symbol)
        order[at] = part[np.lexsort((symbols[depth][part], run[at]))]
    return order


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of suffixes, sorted locally.

    Repeats known inside the bucket come out with edge 0.  The rows of the
    bucket's first and last key, where still alone, come out with edge 1, and one row
    stands for each edge key with its weight (edge 2), to be compared with the
    neighbouring buckets.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    lead, rest, k1, place = (table.column(c).to_numpy() for c in ("lead", "rest", "k1", "place"))
    order = multikey_order([lead, rest])
    lead, rest, k1, place = lead[order], rest[order], k1[order], place[order]
    n = len(lead)
    new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])])
    run = np.cumsum(new) - 1
    weight = 1 + (place >> 31 & 1)
    total = np.bincount(run, weights=weight).astype(np.int64)
    known = (total[run] >= 2) & (weight == 1)
    edges = np.unique(run[[0, n - 1]])
    alone = np.isin(run, edges) & (total[run] == 1)
    heads = np.flatnonzero(new)[edges]
    rows = np.concatenate([np.flatnonzero(known), np.flatnonzero(alone), heads])
    edge = np.concatenate([np.zeros(known.sum()), np.ones(alone.sum()), np.full(len(heads), 2)]).astype(np.int32)
    w = np.concatenate([np.zeros(len(rows) - len(heads)), total[edges]]).astype(np.int64)
    columns = {"lead": lead[rows], "rest": rest[rows], "k1": k1[rows], "k2": place[rows] >> 32 & 0xFFFFFFFF, "p": place[rows] & 0x7FFFFFFF, "edge": edge, "w": w}
    for at in range(0, len(rows), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(v[at : at + (1 << 18)]) for v in columns.values()], list(columns))


def sorted_repeats(suffixes: DataFrame) -> DataFrame:
    """(k1, k2, p) of every suffix row of weight 1 whose key occurs elsewhere.

    Buckets are as many as the shuffle's partitions, or more where one would
    hold over BUCKET suffixes on average.
    """
    buckets = max(partitions(suffixes.sparkSession), -(-suffixes.count() // BUCKET))
    dealt = suffixes.repartitionByRange(buckets, "lead", "rest", "k1", "place")
    out = Stored(dealt.mapInArrow(lean(_bucket, None), "lead long, rest long, k1 long, k2 long, p long, edge int, w long"), "suffix-buckets")
    # at most two rows a bucket meet here
    across = out.df.filter("edge = 2").groupBy("lead", "rest").agg(F.sum("w").alias("both")).filter("both > 1")
    at_edge = out.df.filter("edge = 1").join(across.select(F.col("lead").alias("l"), F.col("rest").alias("r")), (F.col("lead") == F.col("l")) & (F.col("rest") == F.col("r")), "left_semi")
    return out.df.filter("edge = 0").unionByName(at_edge).select("k1", "k2", "p")


class Corpus:
    """The distinct texts of a table, bucketed by their key in the shared folder.

    Only the catalogue keeps a table's buckets, so it is registered in a
    database of its own, which goes with it.
    """

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.path = scratch(self.spark, "texts")
        self.database = "resona_" + self.path.rsplit("-", 1)[1]
        k1, k2 = text_key()
        raw = whole_text()
        distinct = docs.select(k1, k2, raw.alias("text")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
        distinct = distinct.select("k1", "k2", "copies", F.col("text").cast("binary").alias("text"))
        self.spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.path}'")
        writer = distinct.write.format("parquet").option("compression", "zstd").option("path", self.path + "/texts")
        writer.bucketBy(partitions(self.spark), "k1", "k2").saveAsTable(f"{self.database}.texts")
        self.df = self.spark.table(f"{self.database}.texts")

    def with_lists(self, lists: DataFrame, how: str) -> DataFrame:
        """The texts joined with one row of ``lists`` per key; the texts are not shuffled."""
        return self.df.join(lists.hint("shuffle_hash"), ["k1", "k2"], how)

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        drop_path(self.spark, self.path)


def runs(corpus: Corpus, length: int = LENGTH, gram: int = GRAM, kind: type = Bytes) -> DataFrame:
    """(k1, k2, a, b): windows a..b of the text each repeat elsewhere.  All repeats are covered."""
    slim = corpus.df.select("k1", "k2", "copies", "text").filter(F.octet_length("text") >= length)
    found = Stored(slim.mapInArrow(lean(_anchor_rows(kind, length, gram)), "gram long, span long, k1 long, k2 long, run long, w long"), "anchors")
    # one row for each span of each gram, with how often it occurs (2: twice or more) and one place of it
    spans = Stored(
        found.df.groupBy("gram", "span").agg(F.sum("w").alias("w"), F.min(F.struct("k1", "k2", "run")).alias("at")), "spans"
    )
    release(corpus.spark)
    classes = spans.df.groupBy("gram").agg(F.count(F.lit(1)).alias("spans"), F.min("w").alias("least"), F.sum("w").alias("w"))
    # grams that repeat, with at least one span that does not
    open_grams = classes.filter("w > 1 AND least = 1").select(F.col("gram").alias("g"))
    lists = (
        spans.df.join(open_grams, F.col("gram") == F.col("g"), "left_semi")
        .select("at.k1", "at.k2", F.struct(F.col("at.run").alias("run"), F.least("w", F.lit(2)).alias("w")).alias("r"))
        .groupBy("k1", "k2").agg(F.collect_list("r").alias("runs"))  # as many as the text has anchors
    )
    lists = Stored(lists, "open-runs")
    twice = spans.df.filter("w > 1").select(F.col("gram").alias("g"), F.col("span").alias("s"))
    start = F.shiftright("run", 32)
    end = start + F.shiftright("run", 16).bitwiseAND(F.lit(0xFFFF)) + F.col("run").bitwiseAND(F.lit(0xFFFF))
    settled = found.df.join(twice, (F.col("gram") == F.col("g")) & (F.col("span") == F.col("s")), "left_semi")
    settled = Stored(settled.select("k1", "k2", start.alias("a"), end.alias("b")), "settled-runs")
    found.drop()
    spans.drop()
    release(corpus.spark)
    suffixes = Stored(
        corpus.with_lists(lists.df, "inner").select("k1", "k2", "text", "runs").mapInArrow(lean(_window_rows(kind, length)), "lead long, rest long, k1 long, place long"), "suffixes"
    )
    release(corpus.spark)
    single = sorted_repeats(suffixes.df).select("k1", "k2", F.col("p").alias("a"), F.col("p").alias("b"))
    suffixes.drop()
    release(corpus.spark)
    return settled.df.unionByName(single)


def _covered(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered intervals [start, end) of a text's units with repeated windows a..b."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order] + length)
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[first], b[np.concatenate([first[1:], [len(a)]]) - 1]


def _cut(kind: type, length: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7 if with_text else 6)]
            texts, k1, k2, lists = (batch.column(c) for c in ("text", "k1", "k2", "runs"))
            bound, (starts, ends) = _flat(lists, "a", "b")
            for i in range(batch.num_rows):
                text = texts[i].as_buffer().to_pybytes()
                own = slice(bound[i], bound[i + 1])
                a, b = _covered(starts[own], ends[own], length)
                if len(a):
                    a, b = kind(text).extent(a, b)
                if with_text:
                    a, b = whole_characters(text, a, b)
                kept, at = [], 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                left = b"".join(kept)
                row = [k1[i].as_py(), k2[i].as_py(), len(text), int((b - a).sum()), len(a), hashlib.sha256(left).hexdigest()]
                for into, v in zip(out, row + ([left.decode("utf-8", "replace")] if with_text else []), strict=True):
                    into.append(v)
            names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(out)]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=False)], names)

    return rows


def whole_characters(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals shrunk to whole UTF-8 characters, so that the rest stays valid text."""
    more = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while x < y and more(x):
            x += 1
        while y > x and more(y):
            y -= 1
        if x < y:
            out.append((x, y))
    return np.array([p[0] for p in out], np.int64), np.array([p[1] for p in out], np.int64)


def _removals(docs: DataFrame, length: int, gram: int, kind: type, with_text: bool) -> DataFrame:
    """One row per distinct text."""
    corpus = Corpus(docs)
    release(corpus.spark)
    found = runs(corpus, length, gram, kind)
    lists = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))  # bounded by the text itself
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    cut = Stored(corpus.with_lists(lists, "left").select("k1", "k2", "text", "runs").mapInArrow(lean(_cut(kind, length, with_text)), schema), "cut")
    corpus.drop()
    release(corpus.spark)
    return cut.df


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a ``length``-byte string that covers it starts anywhere
    else too, in any row.  Null text counts as empty; texts shorter than
    ``length`` lose nothing; rows that repeat a text of at least ``length``
    bytes lose all of it; a very long text is hashed piece by piece; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    cut = _removals(docs, length, gram, Bytes, False)
    keyed = docs.select("doc_id", *text_key())
    return keyed.join(cut, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = WORDS, gram: int = WORD_GRAM, kind: type = Words) -> DataFrame:
    """The documents with the repeated passages cut out of text, and n_chars to match.

    A passage is a string of ``length`` words (with ``kind`` Bytes: bytes) that
    starts anywhere else too; white space between words does not tell passages
    apart, and the white space after a cut goes with it.  Cuts of bytes shrink to
    whole characters.  A document that is repeated whole keeps its row with an
    empty text; null text stays null; an empty table gives no rows; other columns
    stay as they are, whatever their names.
    """
    cut = _removals(docs, length, gram, kind, True).filter("n_spans > 0").select(F.col("k1").alias("__cut1"), F.col("k2").alias("__cut2"), F.col("kept").alias("__kept"))
    k1, k2 = text_key()
    keyed = docs.withColumns({"__doc1": k1, "__doc2": k2})
    joined = keyed.join(cut, (F.col("__doc1") == F.col("__cut1")) & (F.col("__doc2") == F.col("__cut2")), "left")
    changed = F.col("__cut1").isNotNull() & F.col("text").isNotNull()
    out = {"text": F.when(changed, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.char_length("__kept").cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(out).select(*docs.columns)
