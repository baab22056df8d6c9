"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids and an end id; only those longer than a sequence are
cut.  What is packed is the histogram of piece lengths, at most CAPACITY
numbers whatever the size of the corpus: for the longest open piece, hash
indexes of single lengths, of pair sums and of triple sums, built once, give
combinations that fill its gap exactly, consumed in bulk under the counts still available;
what has no exact complement is packed best-fit decreasing.  The plan is a list
of layouts with multiplicities.  Pieces then take places by their rank among
the pieces of their length.

``pack_mixed`` also keeps the order of the source mix: the copies of each layout
are spread evenly over the sequences, and pieces rank by their place in the mix,
so that the first sequences hold the first places of every length.
"""

from __future__ import annotations

import bisect
import json
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import HELD, Stored, lean, partitions, piece_count, release, spread_rank, text_key

CAPACITY = 2048
END_ID = 0
#: Entries of either generation of a worker's memory of chunks and words; what is forgotten is encoded again.
REMEMBERED = 450_000
#: Copies of a layout that travel in one row.
COPIES = 4096
#: Multiples of it, modulo 1, are spread evenly.
GOLDEN = 0.6180339887498949
#: The word pattern of a lower-casing byte-level tokenizer, applied to normalised text, and its parts.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "truncation": None, "padding": None, "post_processor": None,
}


class _Memory:
    """A mapping of bounded size: what is used stays, what was not used lately goes."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take letters from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def remembers_words(path: str) -> bool:
    """Whether the tokenizer's parts are those under which ids of words can be remembered."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    model = read["model"]
    return (
        all(read.get(k) == v for k, v in PARTS.items()) and model.get("type") == "BPE" and not model.get("dropout")
        and all(t["content"].startswith("<|") for t in read.get("added_tokens", ()))
    )


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids (little-endian unsigned 32-bit) under the tokenizer of a file.

    A byte-level tokenizer of lower-cased words (``remembers_words``) never joins
    across white space, so ids of white-space separated chunks, and of their
    words, are remembered by each worker.  Texts with characters whose normal
    form, case or spacing Python may see differently, and all texts under any
    other tokenizer, go through the tokenizer whole.
    """
    held = HELD.setdefault(__name__, {})
    if path in held:
        return held[path]
    import re

    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    chunks, words = _Memory(REMEMBERED), _Memory(REMEMBERED)
    letters = _byte_letters()
    unusual = re.compile("[^\\x00-\\x1b\\x20-\u024f]|\u0130|<\\||\\x85|\\xa0")
    split = regex.compile(WORDS).findall
    pack_id = struct.Struct("<I").pack

    def encode(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    if not remembers_words(path):
        held[path] = encode
        return encode

    def word(w: str) -> bytes:
        ids = words.get(w)
        if ids is None:
            tokens = model.tokenize(w.encode("utf-8").decode("latin-1").translate(letters))
            ids = b"".join([pack_id(t.id) for t in tokens])
            if len(w) <= 64:
                words.put(w, ids)
        return ids

    def chunk(c: str) -> bytes:
        ids = chunks.get(c)
        if ids is None:
            if c.isalpha():
                ids = word(c)
            elif c[:-1].isalpha() and not c[-1].isnumeric():  # a word and one mark
                ids = word(c[:-1]) + word(c[-1])
            else:
                ids = b"".join([word(w) for w in split(c)])
            if len(c) <= 64:
                chunks.put(c, ids)
        return ids

    def whole(text: str) -> bytes:
        if unusual.search(text) or not unicodedata.is_normalized("NFC", text):
            return encode(text)
        pieces = text.lower().split()
        found = list(map(chunks.young.get, pieces))
        if None in found:
            found = [chunk(c) if ids is None else ids for c, ids in zip(pieces, found, strict=True)]
        return b"".join(found)

    held[path] = whole
    return whole


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str, capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            row: list[int] = []
            piece: list[int] = []
            length: list[int] = []
            crc: list[int] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for j, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(j)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
            start = pa.array(np.array(piece, np.int64) * capacity)
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(piece, pa.int32()), start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        _pieces(tokenizer or default_tokenizer(), capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def _grouped(sums: np.ndarray, members: np.ndarray) -> dict[int, np.ndarray]:
    """The members of each sum, largest first."""
    order = np.lexsort((-members, sums))
    sums, members = sums[order], members[order]
    heads = np.flatnonzero(np.concatenate([[True], sums[1:] != sums[:-1]])) if len(sums) else np.zeros(0, np.int64)
    return dict(zip(sums[heads].tolist(), np.split(members, heads[1:]), strict=True)) if len(sums) else {}


class _Open:
    """Lengths still available, and hash indexes of what they add up to.

    ``pairs`` maps a sum to the larger lengths of the pairs that have it,
    ``triples`` to the largest lengths of the triples.  Lengths that are used up
    never return, so entries that need them are dropped when they are met.
    """

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)
        have = np.array(self.lengths, np.int64)
        self.available = np.zeros(capacity + 1, bool)
        self.available[have] = True
        reached = np.zeros(capacity + 1, bool)  # sums of pairs of lengths up to the one at hand
        pairs, triples = [], []
        for at, a in enumerate(self.lengths):
            two = a + have[: at + 1]
            two = two[two < capacity]
            pairs.append((two, np.full(len(two), a)))
            reached[two] = True
            three = np.flatnonzero(reached[: max(0, capacity - a)]) + a
            triples.append((three, np.full(len(three), a)))
        none = [(np.zeros(0, np.int64),) * 2]
        self.pairs, self.triples = (_grouped(*(np.concatenate(x) for x in zip(*(found or none), strict=True))) for found in (pairs, triples))

    def take(self, layout: tuple[int, ...], times: int) -> None:
        for n in layout:
            self.counts[n] -= times
            if not self.counts[n]:
                del self.counts[n]
                self.available[n] = False
                self.lengths.pop(bisect.bisect_left(self.lengths, n))

    def times(self, layout: tuple[int, ...]) -> int:
        """How often the layout can be taken."""
        need: dict[int, int] = {}
        for n in layout:
            need[n] = need.get(n, 0) + 1
        return min(self.counts.get(n, 0) // k for n, k in need.items())

    def single(self, first: int, gap: int) -> tuple[int, ...] | None:
        return (first, gap) if self.times((first, gap)) else None

    def pairs_of(self, total: int) -> np.ndarray:
        """Larger lengths of the pairs of this sum that are still available."""
        found = self.pairs.get(total)
        if found is None:
            return np.zeros(0, np.int64)
        self.pairs[total] = found = found[self.available[found] & self.available[total - found]]
        return found

    def pair(self, first: int, gap: int) -> tuple[int, ...] | None:
        """The pair with the largest length that fills the gap."""
        for a in self.pairs_of(gap).tolist():
            if self.times(layout := (first, a, gap - a)):
                return layout
        return None

    def triple(self, first: int, gap: int) -> tuple[int, ...] | None:
        """The triple with the largest lengths that fills the gap."""
        found = self.triples.get(gap, np.zeros(0, np.int64))
        lost = []
        layout = None
        for a in found[self.available[found]].tolist():
            rest = self.pairs_of(gap - a)
            rest = rest[rest <= a]
            if not len(rest):
                lost.append(a)
            layout = next((x for b in rest.tolist() if self.times(x := (first, a, b, gap - a - b))), None)
            if layout:
                break
        self.triples[gap] = found[self.available[found] & ~np.isin(found, lost)]
        return layout


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); every piece is in one.

    Exact layouts first, longest piece first; a layout is taken as often as the
    counts allow, so each step uses up a length.  Pieces without an exact
    complement go best-fit decreasing into the fullest sequence they fit.
    """
    open_ = _Open(counts, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    residual: dict[int, int] = {}
    while open_.lengths:
        first = open_.lengths[-1]
        gap = capacity - first
        if gap == 0:
            layout = (first,)
        else:
            layout = open_.single(first, gap) or open_.pair(first, gap) or open_.triple(first, gap)
        if layout:
            times = open_.times(layout)
            open_.take(layout, times)
            out.append((layout, times))
        else:
            residual[first] = open_.counts[first]
            open_.take((first,), open_.counts[first])
    return out + _best_fit(residual, capacity)


def _best_fit(counts: Mapping[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal sequences are handled together."""
    bins: dict[int, list[list]] = {}  # gap -> [[layout, times]]
    gaps: list[int] = []

    def put(gap: int, layout: tuple[int, ...], times: int) -> None:
        if gap not in bins:
            bins[gap] = []
            bisect.insort(gaps, gap)
        bins[gap].append([layout, times])

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                if left >= each:
                    put(capacity - each * n, (n,) * each, left // each)
                    left %= each
                else:
                    put(capacity - left * n, (n,) * left, 1)
                    left = 0
                continue
            gap = gaps[at]
            layout, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(at)
            each = min(gap // n, left)
            many = min(times, left // each)
            if times > many:
                put(gap, layout, times - many)
            put(gap - each * n, layout + (n,) * each, many)
            left -= each * many
    return [(layout, times) for kept in bins.values() for layout, times in kept]


def _segments(layouts: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Which sequence and offset each rank of each length gets.

    Ranks [from, from + times) of a length go to sequences base, base + 1, ...
    at one offset.
    """
    used: dict[int, int] = {}
    rows = []
    base = 0
    for layout, times in layouts:
        offset = 0
        for n in layout:
            rank = used.get(n, 0)
            rows.append((n, rank, base, offset))
            used[n] = rank + times
            offset += n
        base += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "base", "offset"), columns, strict=True))


def _places(segments: dict[str, np.ndarray]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by length, then rank: ranks stay far below 2**50
        keys = segments["length"] << 50 | segments["rank"]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 50 | rank, side="right") - 1
            sequence = segments["base"][at] + rank - segments["rank"][at]
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(sequence), pa.array(segments["offset"][at])], [*keep, "sequence_id", "offset"]
            )

    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and packs as the end id alone; a very long one is
    cut into pieces; rows that repeat a doc_id or a text are packed each; ties among equal lengths go by (doc_id,
    piece, ids_crc32); an empty table gives no rows; other columns are ignored.
    """
    cut = Stored(pieces(docs, tokenizer, capacity), "pieces")
    release(docs.sparkSession)
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in cut.df.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = _segments(plan(counts, capacity))
    ranked = spread_rank(cut.df, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.df.schema.fields)
    return ranked.select(*cut.df.columns, "_rank").mapInArrow(_places(segments), f"{schema}, sequence_id long, offset long")


def _documents(path: str, capacity: int, kind: pa.DataType):
    """The pieces of each row as one list, beside the row's other columns but its text."""
    cut = _pieces(path, capacity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], ["doc_id", "text"])
            (found,) = cut([numbered])
            ends = np.cumsum(np.bincount(found.column("doc_id").to_numpy(), minlength=batch.num_rows))
            each = pa.StructArray.from_arrays([found.column(c) for c in PIECE], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), each)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "cut"])

    return rows


#: Columns of a piece.
PIECE = ("piece", "start", "length", "ids_crc32")


def mixed_pieces(docs: DataFrame, weights: Mapping[str, float] | None = None, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the row's position in the mix, of every piece."""
    slim = docs.select("doc_id", "source", *text_key(), F.col("text").cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    kind = pa.list_(pa.struct([("piece", pa.int32()), *[(c, pa.int64()) for c in PIECE[1:]]]))
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, k1 long, k2 long, cut array<struct<piece: int, start: long, length: long, ids_crc32: long>>"
    cut = Stored(slim.mapInArrow(lean(_documents(tokenizer or default_tokenizer(), capacity, kind), keeps=__name__), schema), "cut")
    placed = mixing.place(cut.df, weights).select("doc_id", "position", F.explode("cut").alias("p"))
    return placed.select("doc_id", *[f"p.{c}" for c in PIECE], "position")


def _sequences(spark: SparkSession, layouts: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """length, offset and sequence_id of every place: copy i of a layout taken n times stands at (i + x) / n of the way, x spread evenly over the layouts."""
    rows = [(at, list(layout), times, a, min(a + COPIES, times)) for at, (layout, times) in enumerate(layouts) for a in range(0, times, COPIES)]
    chunks = spark.createDataFrame(rows, "layout int, lengths array<long>, times long, a long, b long").repartition(partitions(spark))
    copies = chunks.withColumn("i", F.explode(F.sequence("a", F.col("b") - 1))).withColumn("at", (F.col("i") + F.col("layout") * GOLDEN % 1) / F.col("times"))
    salts = piece_count(spark)
    ranked = spread_rank(copies.select("layout", "lengths", "at"), [], ["at", "layout"], "sequence_id", salt=F.floor(F.col("at") * salts))
    placed = ranked.select("sequence_id", "lengths", F.posexplode("lengths").alias("n", "length"))
    before = F.aggregate(F.slice("lengths", 1, F.col("n")), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select("sequence_id", "length", before.alias("offset"))


def pack_mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """What ``pack`` gives, with sequences in the order of the mix to ``weights``.

    Sequences are numbered from 0 without gaps; of the pieces of one length, the
    earlier in the mix stands in the earlier sequence.
    """
    spark = docs.sparkSession
    cut = Stored(mixed_pieces(docs, weights, tokenizer, capacity), "mixed-pieces")
    release(spark)
    found = cut.df.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last")).collect()  # at most `capacity` rows
    layouts = plan({r["length"]: r["n"] for r in found}, capacity)
    salts = piece_count(spark)

    def ranked(rows: DataFrame, order: list[str], size: int) -> DataFrame:
        return spread_rank(rows, ["length"], order, "_rank", salt=F.floor(F.col(order[0]) * salts / size))

    pieces_ = ranked(cut.df, ["position", "piece"], max((r["last"] for r in found), default=0) + 1)
    places = ranked(_sequences(spark, layouts), ["sequence_id", "offset"], max(1, sum(times for _, times in layouts)))
    places = places.select(F.col("length").alias("_length"), F.col("_rank").alias("_place"), "sequence_id", "offset")
    same = (F.col("length") == F.col("_length")) & (F.col("_rank") == F.col("_place"))
    return pieces_.join(places, same).select("doc_id", *PIECE, "sequence_id", "offset")
