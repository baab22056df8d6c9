"""Near copies by the Jaccard similarity of word shingles.

Texts with the same set of shingles are one node.  MinHash bands bring nodes
together: two nodes of similarity s share a band with probability
1 - (1 - s ** ROWS) ** BANDS, 0.99994 at 0.8.  Every pair that becomes a link is
verified on the whole sets.  Short lists give all their pairs.  A list of more
than SHORT nodes first gives each node's pairs with its neighbours and with the
list's smallest node, which join most of a large group in proportion to its size.
Where such a list still has nodes of several classes, every pair of nodes that are
not in one class is compared, by counts of shared shingles over blocks of bounded
size, so that classes are those of all pairs that share a band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, lean, ranges, release, text_key
from .components import components

WORDS = 5
SIMILARITY = 0.8
SEED = 42
BANDS, ROWS = 32, 6
#: Nodes of a list that gives all its pairs at once.
SHORT = 16
#: Shingles of a block of nodes that are compared with another block.
AT_ONCE = 1 << 18
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of ``words`` words; one of all words where there are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(found) - words + 1)]
    tails = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), tails.tolist(), strict=True)], dtype=np.uint64))


def node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def bands(found: np.ndarray) -> np.ndarray:
    """One key a band of the MinHash signature."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (_FACTORS[:, None] * found[None, at : at + 1024]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return ((rows ^ rows >> np.uint64(29)) * _MIX).sum(axis=1, dtype=np.uint64)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _signatures(words: int, mark: Callable[[str | None], int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            keys = np.array([bands(s) for s in sets], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "k1", "k2")], _signed([node(s) for s in sets]), _signed([mark(t) for t in batch.column("text").to_pylist()]), pa.array([len(s) for s in sets], pa.int64()), lists],
                ["doc_id", "k1", "k2", "fp", "mark", "n", "bands"],
            )

    return rows


def _pairs(similarity: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u: list[int] = []
            v: list[int] = []
            for found in batch.column("nodes").to_pylist():
                members = sorted((m["fp"], m["n"]) for m in found)
                m = len(members)
                near = [(a, b) for a in range(m) for b in range(a + 1, m)] if m <= SHORT else [(max(0, a - 1), a) for a in range(1, m)] + [(0, a) for a in range(2, m)]
                for a, b in near:
                    (x, p), (y, q) = members[a], members[b]
                    if min(p, q) >= similarity * max(p, q) - 1e-9:
                        u.append(x)
                        v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows


def _sets(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["fp", "set"])

    return rows


def _cross(similarity: float):
    """Links between nodes of different roots of one pair of blocks (i, j); one for each two classes that they join."""

    def rows(key: tuple, table: pa.Table) -> pa.Table:
        fp, root, block = (table.column(c).to_numpy() for c in ("fp", "root", "block"))
        lists = table.column("set").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        token = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        holders = np.repeat(np.arange(len(n)), n)[np.argsort(token, kind="stable")]
        many = np.bincount(token)
        starts = np.cumsum(many) - many
        values, of_root, times = np.unique(root, return_inverse=True, return_counts=True)
        parent = list(range(len(values)))

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        u, v = [], []
        # of two nodes with different roots one is not of the largest class
        for x in np.flatnonzero(of_root != times.argmax()).tolist():
            own = token[ends[x] : ends[x + 1]]
            shared = np.bincount(holders[ranges(starts[own], many[own])], minlength=len(n))
            near = (shared >= similarity * (n[x] + n - shared) - 1e-9) & (of_root != of_root[x])
            if key[2].as_py() != key[3].as_py():
                near &= block != block[x]
            for y in np.flatnonzero(near).tolist():
                a, b = find(of_root[x]), find(of_root[y])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    u.append(fp[x])
                    v.append(fp[y])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows


def across(members: DataFrame, linked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join classes of ``linked`` within the lists (band, key) of ``members`` (fp, n).

    A list is cut by length into blocks of about AT_ONCE shingles; pairs of blocks
    that hold one class alone, or whose lengths are too far apart, are left out.
    """
    roots = components(linked, "copies-roots")
    by_length = Window.partitionBy("band", "key").orderBy("n", "fp")
    placed = members.join(roots, members["fp"] == roots["node"], "left").select("band", "key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    placed = placed.withColumns({"_least": F.min("root").over(Window.partitionBy("band", "key")), "_most": F.max("root").over(Window.partitionBy("band", "key"))}).filter("_least < _most")
    placed = Stored(placed.select("band", "key", "fp", "root", "n", F.floor(F.sum("n").over(by_length.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(AT_ONCE)).alias("block")), "copies-blocks").df
    blocks = placed.groupBy("band", "key", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("r"), F.max("root").alias("s"))
    low = blocks.select("band", "key", F.col("block").alias("i"), "most", F.col("r").alias("r1"), F.col("s").alias("s1"))
    high = blocks.select("band", "key", F.col("block").alias("j"), "least", "r", "s")
    met = low.join(high, ["band", "key"]).filter((F.col("i") <= F.col("j")) & (F.col("most") >= similarity * F.col("least") - 1e-9) & (F.least("r", "r1") < F.greatest("s", "s1")))
    sides = met.select("band", "key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = placed.join(sides, ["band", "key", "block"]).join(sets, "fp").select("band", "key", "i", "j", "block", "fp", "root", "set")
    return rows.groupBy("band", "key", "i", "j").applyInArrow(_cross(similarity), "u long, v long").distinct()


def signatures(docs: DataFrame, mark: Callable[[str | None], int], words: int = WORDS) -> DataFrame:
    """doc_id, the text's key, fp (the node), the text's mark (a number), n (the node's shingles) and its bands."""
    slim = docs.select("doc_id", *text_key(), F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(lean(_signatures(words, mark)), f"doc_id {kind}, k1 long, k2 long, fp long, mark long, n long, bands array<long>")


def links(docs: DataFrame, found: DataFrame, known: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between the nodes of ``found``, the signatures of ``docs``: the ``known`` ones and the verified ones."""
    nodes = found.filter("n > 0").dropDuplicates(["fp"])
    postings = nodes.select("fp", "n", F.posexplode("bands").alias("band", "key"))
    lists = Stored(postings.groupBy("band", "key").agg(F.collect_list(F.struct("fp", "n")).alias("nodes")).filter(F.size("nodes") > 1), "copies-lists")
    pairs = Stored(lists.df.select("nodes").mapInArrow(lean(_pairs(similarity), None), "u long, v long").distinct(), "copies-pairs")
    release(docs.sparkSession)
    members = lists.df.filter(F.size("nodes") > SHORT).select("band", "key", F.explode("nodes").alias("m")).select("band", "key", "m.fp", "m.n")
    needed = pairs.df.select(F.col("u").alias("fp")).union(pairs.df.select("v")).union(members.select("fp")).distinct()
    one = found.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("k1", "k2")).alias("k")).select("fp", F.col("k.k1").alias("_k1"), F.col("k.k2").alias("_k2"))
    k1, k2 = text_key()
    texts = docs.select(F.col("text").cast("string").alias("text"), k1, k2).join(one, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    sets = Stored(texts.select("fp", "text").mapInArrow(lean(_sets(words)), "fp long, set array<long>").dropDuplicates(["fp"]), "copies-sets")
    a = sets.df.select(F.col("fp").alias("u"), F.col("set").alias("a"))
    b = sets.df.select(F.col("fp").alias("v"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    near = pairs.df.join(a, "u").join(b, "v").filter(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9).select("u", "v")
    near = Stored(near.unionByName(known), "copies-near")
    release(docs.sparkSession)
    if members.isEmpty():
        return near.df
    return near.df.unionByName(across(members, near.df, sets.df, similarity))
