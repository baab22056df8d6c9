"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ
in at most two bits differ in at most two bytes, so they share at least
MATCHES = 6 of the eight positional bytes.  A posting list for one positional
byte would hold 1/256 of all fingerprints; the index is therefore keyed by
sets of six positional bytes (28 sets), whose lists hold at most 2**16 distinct
fingerprints.  A pair meets in a list only if it shares these six, so no pair
below the minimum is ever met; the tally of all shared positional bytes is then
counted, pairs below the minimum go, and the others are verified on bits.

Within a list no pairs are written: fingerprints are linked by a spanning
forest, at most one link per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearcopies
from .common import Stored, lean, partitions, release, text_key
from .components import components

WORDS = 3
SEED = 42
#: Most differing bits of a link.
BITS = 2
BYTES = 8
#: Positional bytes that a linked pair shares at least.
MATCHES = BYTES - BITS


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text; 0 where it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    take = max(1, len(words) - WORDS + 1)
    tails = ends[WORDS - 1 :] if len(words) >= WORDS else ends[-1:]
    digest = xxhash.xxh64_intdigest
    # counts of set bits, in bounded pieces so that a huge text stays small
    ones = np.zeros(64, np.int64)
    for at in range(0, take, 65536):
        piece = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + 65536][: take - at].tolist(), tails[at : at + 65536].tolist(), strict=True)]
        bits = np.unpackbits(np.array(piece, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > take), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "k1", "k2")], pa.array(prints)], ["doc_id", "k1", "k2", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the text's key and fp (the fingerprint's bits as a signed long) of each row."""
    slim = docs.select("doc_id", *text_key(), F.col("text").cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(lean(_fingerprints), f"doc_id {id_type}, k1 long, k2 long, fp long")


def _byte_sets() -> list[tuple[int, int]]:
    """(set number, mask) of each choice of MATCHES positional bytes."""
    out = []
    for n, chosen in enumerate(combinations(range(BYTES), MATCHES)):
        mask = sum(0xFF << 8 * p for p in chosen)
        out.append((n, mask - (1 << 64) if mask >> 63 else mask))
    return out


#: Masks of the differences that still link: none, one or two bits.
_NEAR = np.array([0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)], dtype=np.uint64)


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes the fingerprints share."""
    apart = np.asarray(a ^ b, np.uint64).reshape(-1, 1).view(np.uint8)
    return BYTES - np.count_nonzero(apart, axis=1)


def linked(a: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of the others link to ``a``: enough shared positional bytes, then few enough differing bits."""
    near = np.flatnonzero(tally(a, others) >= MATCHES)
    return near[np.bitwise_count(others[near] ^ a) <= BITS]


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of distinct ``prints`` under at most BITS differing bits.

    Works list by list in time proportional to the list, or to its square for
    the short ones: each print looks up its neighbours among the varying bits.
    """
    prints = np.unique(prints)
    n = len(prints)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []

    def join(a: int, b: int) -> None:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((a, b))

    if n <= 128:
        for i in range(n - 1):
            for j in linked(prints[i], prints[i + 1 :]).tolist():
                join(i, i + 1 + j)
    else:
        vary = np.bitwise_or.reduce(prints ^ prints[0])
        for mask in _NEAR[1:]:
            if mask & ~vary:
                continue
            other = prints ^ mask
            at = np.searchsorted(prints, other)
            hit = np.flatnonzero((other > prints) & (at < n))
            hit = hit[prints[at[hit]] == other[hit]]
            for i, j in zip(hit.tolist(), at[hit].tolist(), strict=True):
                join(i, j)
            if len(links) == n - 1:
                break
    return [(int(prints[a]), int(prints[b])) for a, b in links]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists (array of prints) to verified links."""
    for batch in batches:
        lists = batch.column("prints")
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        u: list[int] = []
        v: list[int] = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a == 2:
                if len(linked(flat[a], flat[a + 1 : a + 2])):
                    u.append(int(flat[a]))
                    v.append(int(flat[a + 1]))
                continue
            for x, y in forest(flat[a:b]):
                u.append(x)
                v.append(y)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"]
        )


def links(prints: DataFrame) -> DataFrame:
    """Spanning links (u, v) between the distinct values of column fp."""
    sets = F.array(*[F.struct(F.lit(n).alias("set"), F.lit(m).cast("long").alias("mask")) for n, m in _byte_sets()])
    distinct = prints.select("fp").distinct().repartition(partitions(prints.sparkSession))  # 8 bytes each; the lists below are 28 times as many rows
    postings = (
        distinct.select("fp", F.explode(sets).alias("s"))
        .select("fp", F.col("s.set").cast("byte").alias("byte_set"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("bytes"))
    )
    lists = postings.groupBy("byte_set", "bytes").agg(F.collect_list("fp").alias("prints")).filter(F.size("prints") > 1)
    return lists.select("prints").mapInArrow(lean(_lists, None), "u long, v long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text key, fp, root (smallest print of its class) and component_id.

    component_id is the smallest non-null doc_id of the class, null where it
    has none.  Null and empty texts have print 0 and link like any other; very
    long texts are read piece by piece; repeated rows keep their count; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    prints = Stored(fingerprints(docs), "simhash")
    return _linked(prints, Stored(links(prints.df), "simhash-links"))


def copies(docs: DataFrame, words: int = nearcopies.WORDS, similarity: float = nearcopies.SIMILARITY) -> DataFrame:
    """What ``classes`` gives, linked by fingerprints as there and by the Jaccard similarity of shingles besides.

    fp is the node of the text's shingles; a node hangs on the smallest node of
    its fingerprint, and the links of the fingerprints are those nodes'.
    """
    found = Stored(nearcopies.signatures(docs, fingerprint, words), "copies")
    marks = found.df.select("mark", "fp").distinct()
    firsts = Stored(marks.groupBy("mark").agg(F.min("fp").alias("first")), "copies-marks").df
    hung = marks.join(firsts, "mark").filter("fp <> first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    near = links(firsts.select(F.col("mark").alias("fp")))
    near = near.join(firsts.select(F.col("mark").alias("u"), F.col("first").alias("a")), "u").join(firsts.select(F.col("mark").alias("v"), F.col("first").alias("b")), "v")
    known = Stored(hung.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v"))), "copies-prints")
    release(docs.sparkSession)
    return _linked(found, Stored(nearcopies.links(docs, found.df, known.df, words, similarity), "copies-links"))


def _linked(prints: Stored, linked: Stored) -> DataFrame:
    release(prints.spark)
    roots = components(linked.df, "simhash-stars")
    nodes = prints.df.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(best.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("fp", "root", "component_id")
    return prints.df.join(of_print.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).select("doc_id", "k1", "k2", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The documents, one row of each class: one with the class's smallest doc_id.

    Classes are ``found``, those of ``copies``, or else op3's.

    Of a class without any doc_id, and of rows that share the smallest, the one
    with the smallest text key stays; of rows that repeat it whole, one.  Null and
    empty texts are a class like any other; an empty table gives no rows; columns
    of any name stay as they are.
    """
    first = F.min(F.struct("k1", "k2"))
    keep = (
        (classes(docs) if found is None else found).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(first.alias("k"), F.first("doc_id").alias("d"))
        .select(F.col("d").alias("__keep_id"), F.col("k.k1").alias("__keep1"), F.col("k.k2").alias("__keep2"))
    )
    k1, k2 = text_key()
    keyed = docs.withColumns({"__doc1": k1, "__doc2": k2})
    same = (F.col("__doc1") == F.col("__keep1")) & (F.col("__doc2") == F.col("__keep2")) & F.col("doc_id").eqNullSafe(F.col("__keep_id"))
    return keyed.join(keep, same, "left_semi").dropDuplicates(["__doc1", "__doc2", "doc_id"]).select(*docs.columns)
