"""Operators that decide over the whole set: SimHash, repeats, sharding, mixing, packing, search."""

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from resona.llm import common, components, mixing, nearcopies, packing, search, sharding, simhash, substrings

from .conftest import make

ROOT = Path(__file__).resolve().parents[2]

def key(i):
    return -1 if i is None else i


# --- SimHash -----------------------------------------------------------------


def brute_print(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not found:
        return 0
    pieces = [b" ".join(found[j : j + 3]) for j in range(max(1, len(found) - 2))]
    ones = [0] * 64
    for p in pieces:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(pieces))


def brute_classes(rows):
    prints = [brute_print(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [(key(i), f"{prints[k]:016x}", min(least[find(k)], default=None), find(k)) for k, (i, *_) in enumerate(rows)]


def test_simhash_matches_brute_force(odd, odd_rows):
    got = [(key(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted((w[:3] for w in brute_classes(odd_rows)), key=str)


def test_simhash_of_long_texts_goes_piece_by_piece():
    text = " ".join(f"w{i}" for i in range(70_000))
    found = [w.encode() for w in text.split()]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(found[j : j + 3]), 42) for j in range(len(found) - 2)], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint(text) == want


def test_posting_lists_miss_no_link(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randint(0, 4)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << b
            prints.add(p)
    hub = rng.getrandbits(64)
    prints |= {hub ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = components.components(simhash.links(df)).collect()
    root = {r.node: r.root for r in got}
    order = sorted(signed)
    parent = {p: p for p in order}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(order):
        for b in order[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {p: root.get(p, p) for p in order} == {p: find(p) for p in order}


def test_forest_of_a_large_list_spans():
    base = np.uint64(0xABCDEF0123456789)
    prints = np.array([int(base) ^ v for v in range(1000)], dtype=np.uint64)
    assert len(simhash.forest(prints)) == 999


def test_components_of_a_long_chain(spark):
    df = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    rows = components.components(df).collect()
    assert len(rows) == 301 and {r.root for r in rows} == {0}


def test_one_of_each_keeps_columns(odd, odd_rows, empty):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    want = brute_classes(odd_rows)
    assert len(rows) == len({w[3] for w in want})
    assert Counter(key(r.doc_id) for r in rows) == Counter({w[3]: key(w[2]) for w in want}.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_tally_counts_shared_bytes():
    a, others = np.uint64(0x0102030405060708), np.array([0x0102030405060708, 0x0102030405060709, 0x01020304050607F8, 0x0102030404060709, 0x0002020405060708, 0x0002020404060708], np.uint64)
    assert simhash.tally(a, others).tolist() == [8, 7, 7, 6, 6, 5]
    assert simhash.linked(a, others).tolist() == [0, 1, 3, 4]


# --- repeats -----------------------------------------------------------------


def brute_repeats(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(spark, odd_rows, empty):
    rows = [r for r in odd_rows if r[0] != 405]
    got = [(key(r.doc_id), *r[1:]) for r in substrings.repeats(make(spark, rows, clashing=True)).collect()]
    want = [(key(i), *b) for (i, *_), b in zip(rows, brute_repeats([(t or "").encode() for _, t, _ in rows], 400), strict=True)]
    assert sorted(got) == sorted(want)
    assert sum(1 for w in want if 0 < w[2] < w[1]) >= 4
    assert substrings.repeats(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_patchworks(spark, seed):
    """Short windows over texts stitched from few pieces: overlaps, runs, many partners."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 40))) for _ in range(12)] + ["a" * 50, "ab" * 20]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    df = make(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = sorted((r.doc_id, *r[1:]) for r in substrings.repeats(df, length=24, gram=9).collect())
    assert got == [(i, *b) for i, b in enumerate(brute_repeats([t.encode() for t in texts], 24))]


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()
    spaced = text.replace(b"a", b" ")
    found = lambda units, *sizes: {k: v.tolist() for k, v in vars(substrings.anchors(units, *sizes)).items()}
    whole = found(substrings.Bytes(text)), found(substrings.Words(spaced), 50, 20)
    assert len(whole[0]["grams"]) > 20 and len(whole[1]["grams"]) > 20
    runs = np.array([w << 32 | 40 for w in range(0, 4500, 300)])
    windows = [np.concatenate(x).tolist() for x in zip(*substrings.windows_of(substrings.Bytes(text), runs, runs % 2 + 1, 400), strict=True)]
    monkeypatch.setattr(substrings, "PIECE", 700)
    assert found(substrings.Bytes(text)) == whole[0]
    monkeypatch.setattr(substrings, "PIECE", 90)
    assert found(substrings.Words(spaced), 50, 20) == whole[1]
    assert [np.concatenate(x).tolist() for x in zip(*substrings.windows_of(substrings.Bytes(text), runs, runs % 2 + 1, 400), strict=True)] == windows


def test_equal_spans_in_a_row_are_one(spark):
    """A text of one pair of words, or of one line, over and over has few anchors however long it is."""
    pair, line = b"ab cd " * 400_000, (b"x" * 150 + b"\n") * 6000
    for found, windows in ((substrings.anchors(substrings.Words(pair), 50, 20), 800_000 - 49), (substrings.anchors(substrings.Bytes(line)), len(line) - 399)):
        assert len(found.grams) < windows / 1000 and found.first[0] == 0 and found.reach[-1] == windows - 1
        assert (found.first[1:] == found.reach[:-1] + 1).all() and found.times.max() > 100 and (found.reach - found.last).max() <= 0xFFFF
    texts = ["ab cd " * 300, "zz " + "ab cd " * 40, "ab " * 49, "line of five words here " * 30 + "end", "q " * 500 + "r " * 500]
    df = make(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert {r.doc_id: r.text.split() for r in substrings.without_repeats(df).collect()} == dict(enumerate(brute_passages(texts, 50)))
    got = sorted((r.doc_id, *r[1:]) for r in substrings.repeats(df, 60, 20).collect())
    assert got == [(i, *b) for i, b in enumerate(brute_repeats([t.encode() for t in texts], 60))]


def test_a_long_text_takes_little_memory():
    """Its hashes go piece by piece: a text of 24 MB takes less than 500 MB."""
    code = (
        "import resource, numpy as np; from resona.llm import substrings as s;"
        "text = np.random.default_rng(1).integers(97, 123, 24_000_000).astype(np.uint8).tobytes();"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; a = s.anchors(s.Bytes(text)); w = text.replace(b'e', b' ');"
        "b = s.anchors(s.Words(w), 50, 20); assert len(a.grams) and len(b.grams);"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)"
    )
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout) < 500


def brute_passages(texts, length):
    """The texts without the words of repeated strings of ``length`` words."""
    lists = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[p : p + length]) for w in lists for p in range(len(w) - length + 1))
    out = []
    for w in lists:
        gone = {i for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1 for i in range(p, p + length)}
        out.append([x.decode() for i, x in enumerate(w) if i not in gone])
    return out


def test_passages_match_brute_force(spark, odd, odd_rows, empty):
    got = [(key(r.doc_id), (r.text or "").split(), r.text is None) for r in substrings.without_repeats(odd).collect()]
    texts = [t for _, t, _ in odd_rows]
    want = [(key(i), w, t is None) for (i, t, _), w in zip(odd_rows, brute_passages(texts, 50), strict=True)]
    assert sorted(got) == sorted(want)
    assert sum(1 for t, (_, w, _) in zip(texts, want, strict=True) if 0 < len(w) < len((t or "").split())) >= 4
    assert substrings.without_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_patchworks(spark, seed):
    rng = random.Random(seed)
    pieces = [[rng.choice(["a", "b", "cc", "über"]) for _ in range(rng.randint(2, 14))] for _ in range(10)] + [["a"] * 30]
    spaces = (" ", "\n", "\t ", "  ")
    texts = ["".join(w + rng.choice(spaces) for _ in range(rng.randint(0, 9)) for w in rng.choice(pieces)) for _ in range(60)]
    df = make(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.text.split() for r in substrings.without_repeats(df, length=12, gram=5).collect()}
    assert got == dict(enumerate(brute_passages(texts, 12)))


def test_cuts_leave_the_rest_as_it_is(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    df = make(spark, [(1, f"first\n\n{passage} \n last  two", "s"), (2, passage.replace(" ", "\n"), "s"), (3, f"{passage[:-1]}9 end", "s")])
    rows = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert (rows[1].text, rows[1].n_chars, rows[2].text) == ("first\n\nlast  two", 16, "")
    assert rows[3].text == f"{passage.split()[-1][:-1]}9 end"


def test_multikey_order_sorts():
    rng = np.random.default_rng(0)
    symbols = [rng.integers(0, 4, 500) for _ in range(3)]
    order = substrings.multikey_order(symbols)
    rows = list(zip(*[s[order].tolist() for s in symbols], strict=True))
    assert rows == sorted(rows)


def test_bucket_edges_meet(spark):
    """A string that fills several buckets is found though no bucket sees it all."""
    rows = [(5, 5, i, (9 << 32) | i) for i in range(40)] + [(1, i, 0, i) for i in range(10)]
    df = spark.createDataFrame(rows, "lead long, rest long, k1 long, place long").repartition(1)
    got = substrings.sorted_repeats(df).collect()
    assert sorted((r.k1, r.p) for r in got) == [(i, i) for i in range(40)]


def test_cut_texts_stay_valid(spark):
    a, b = "é" * 300, "xé" * 150
    df = make(spark, [(1, "q" + a + b, "s"), (2, a + b + "ü", "s"), (3, None, "s"), (4, a, "s")])
    rows = {r.doc_id: r for r in substrings.without_repeats(df, 400, 200, substrings.Bytes).collect()}
    assert rows[3].text is None and rows[3].n_chars is None
    assert rows[1].text == "q" and rows[2].text == "ü" and rows[1].n_chars == 1 and rows[4].text == ""


def test_without_repeats_keeps_columns(odd):
    out = substrings.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


# --- sharding ----------------------------------------------------------------


def test_shards_are_even_and_gapless(spark, odd, odd_rows, empty):
    rows = sharding.shard_documents(odd, shards=7, slots=64).collect()
    assert sorted((key(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted((key(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(places) <= set(range(7)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(empty).count() == 0


def test_shards_are_near_equal(spark, small):
    rows = sharding.shard_documents(spark.read.parquet(f"{small}/documents.parquet"), shards=8).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 8


def test_the_map_is_kept_and_edited(spark, tmp_path):
    """Runs over the same folder: the map is taken up, edited where loads have changed, and every version stays."""
    folder = f"file://{tmp_path}/maps"
    rng = random.Random(31)
    base = [(i, "x" * rng.randint(1, 400), "s") for i in range(1500)]
    run = lambda rows, shards=6: {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_documents(make(spark, rows), shards, 256, folder).collect()}
    first = run(base)
    known = sharding.versions(spark, folder)
    assert known == [1, 2] and {v for _, v in first.values()} == {2}
    assert run(base) == first and sharding.versions(spark, folder) == known
    grown = run([*base, *((5000 + i, "y" * 3000, "s") for i in range(12))])
    assert sharding.versions(spark, folder) == [1, 2, 3] and {v for _, v in grown.values()} == {3}
    moved = sum(first[i][0] != grown[i][0] for i in first)
    assert 0 < moved < 0.35 * len(first)
    maps = {v: {r.vslot: r.shard for r in sharding.load_map(spark, folder, v).collect()} for v in (1, 2, 3)}
    assert all(len(m) == 256 for m in maps.values()) and maps[1] == {i: i % 6 for i in range(256)}
    assert {i: maps[2][s.vslot] for i, s in ((r.doc_id, r) for r in sharding.sized(make(spark, base), 256).collect())} == {i: s for i, (s, _) in first.items()}
    fewer = run(base, 5)
    assert {s for s, _ in fewer.values()} == set(range(5)) and sharding.versions(spark, folder)[-1] == 4
    with pytest.raises(ValueError):
        sharding.store_map(sharding.load_map(spark, folder), folder, 2)


def test_rebalancing_moves_little(spark):
    loads = spark.createDataFrame([(i, 100 + (900 if i == 3 else 0)) for i in range(64)], "vslot int, slot_bytes long")
    first = sharding.first_map(spark, 4, 64)
    second = sharding.rebalance(first, loads, 4)
    before = {r.vslot: r.shard for r in first.collect()}
    after = {r.vslot: r.shard for r in second.collect()}
    assert {r.version for r in second.collect()} == {2} and set(after) == set(range(64))
    moved = [s for s in after if after[s] != before[s]]
    assert 0 < len(moved) <= 10
    grown = {r.vslot: r.shard for r in sharding.rebalance(second, loads, 5).collect()}
    assert set(grown.values()) == set(range(5))


# --- mixing ------------------------------------------------------------------


def test_a_period_stays_within_a_block():
    for weights in ({"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1.0}, {str(i): 1 + i for i in range(40)}):
        share = mixing.quantize(weights)
        assert sum(share.values()) == mixing.QUANTA
        seen, worst = Counter(), 0.0
        for t, s in enumerate(mixing.period(share), 1):
            seen[s] += 1
            worst = max(worst, *(abs(seen[x] - t * share[x] / mixing.QUANTA) for x in share))
        assert worst < 1 and seen == Counter(share)


def test_phases_use_every_block_once():
    blocks = {"a": 300, "b": 70, "c": 5, "d": 1000, "e": 0}
    plan = mixing.plan_phases(blocks, mixing.temperature_weights({k: max(v, 1) for k, v in blocks.items()}), 64)
    slots = {}
    for p in plan:
        for i in range(p["n_blocks"]):
            slots[p["base"] + i // p["share"] * 64 + p["at"][i % p["share"]]] = (p["source"], p["first_block"] + i, p["phase"])
    assert sorted(slots) == list(range(sum(blocks.values())))
    assert sorted((s, b) for s, b, _ in slots.values()) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    # in every phase each source is within one block of its share
    share = {(p["phase"], p["source"]): p["share"] / 64 for p in plan}
    seen, start, phase = Counter(), 0, 0
    for t in range(len(slots)):
        s, _, f = slots[t]
        if f != phase:
            seen, start, phase = Counter(), t, f
        seen[s] += 1
        assert all(abs(seen[x] - w * (t + 1 - start)) < 1 for (g, x), w in share.items() if g == f)


def test_every_prefix_keeps_within_a_block_of_the_target_weights():
    hot = {"hot": 9000, **{f"s{i}": 2300 for i in range(19)}}
    for blocks, weights in ((hot, mixing.temperature_weights({**hot, "hot": 13_000})), ({"a": 9_000, "b": 40, "c": 3_000}, {"a": 1.0, "b": 1e-4, "c": 0.3})):
        who = {slot: (s, f) for s, (slots, phases) in mixing.schedule(blocks, weights).items() for slot, f in zip(slots, phases, strict=True)}
        assert sorted(who) == list(range(sum(blocks.values()))) and Counter(s for s, _ in who.values()) == Counter(blocks)
        total, seen, worst = sum(weights.values()), Counter(), 0.0
        for t in range(len(who)):
            s, phase = who[t]
            if phase:
                break
            seen[s] += 1
            worst = max(worst, *(abs(seen[x] - (t + 1) * w / total) for x, w in weights.items()))
        assert t > 5_000 and worst < 1
    with pytest.raises(ValueError, match="negative"):
        mixing.schedule({"a": 1}, {"a": -1.0})


def test_mix_follows_its_target_weight(spark):
    docs = make(spark, [(i, f"t{i}", "hot" if i % 3 else f"s{i % 19}") for i in range(6_000)])
    rows = mixing.mix(docs, block=1).collect()
    target, seen = {r.source: r.target_weight for r in rows}, Counter()
    for t, r in enumerate(sorted((r for r in rows if r.phase == 0), key=lambda r: r.position), 1):
        assert r.position == t - 1
        seen[r.source] += 1
        assert all(abs(seen[s] - t * w) < 1 for s, w in target.items())
    assert t > 1_300


def test_large_tables_take_larger_blocks(spark, monkeypatch):
    """The plan on the driver keeps its bound; weights hold to within one of the larger blocks."""
    monkeypatch.setattr(mixing, "MOST_BLOCKS", mixing.MAX_SOURCES + 40)
    df = make(spark, [(i, f"text {i}", "ab"[i % 5 == 0]) for i in range(4000)])
    rows = sorted((r.position, r.source, r.target_weight, r.phase, r.block) for r in mixing.mix(df, {"a": 1.0, "b": 1.0}).collect())
    assert [r[0] for r in rows] == list(range(4000)) and max(r[4] for r in rows) < 40
    seen = Counter()
    for position, source, weight, phase, _ in rows:
        seen[source] += 1
        if phase == 0:
            assert abs(seen[source] - weight * (position + 1)) < 2 * 100


def test_mix_places_every_row(odd, odd_rows, empty):
    rows = mixing.mix(odd, block=4, quanta=64).collect()
    assert sorted(r.position for r in rows) == list(range(len(odd_rows)))
    assert Counter((key(r.doc_id), r.source) for r in rows) == Counter((key(i), s) for i, _, s in odd_rows)
    by_place = sorted(rows, key=lambda r: r.position)
    assert all(a.slot <= b.slot for a, b in zip(by_place, by_place[1:], strict=False))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    named = mixing.mix(odd, {"hot": 3.0, "s0": 1.0}, block=4, quanta=64)
    assert named.count() == len(odd_rows)


def test_mixed_documents_keep_rows_and_order(odd, odd_rows):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert Counter((key(r.doc_id), r.text, r.source, r.k1) for r in out.collect()) == Counter((key(i), t, s, "extra k1") for i, t, s in odd_rows)


# --- near copies ---


def test_near_copies_of_single_edits_are_one(spark):
    rng, rows, pairs = random.Random(8), [], 0
    for i in range(60):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        rows.append((10 * i, " ".join(text), "s"))
        for k in range(1, 4):
            edited = list(text)
            for _ in range(k):
                edited[rng.randrange(len(text))] = f"x{rng.randrange(5000)}"
            rows.append((10 * i + k, " ".join(edited), "s"))
    rows += [(9000 + i, f"one common line of six words {i} {rng.random()} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)), "s") for i in range(40)]
    sets = {i: set(nearcopies.shingles(t).tolist()) for i, t, _ in rows}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs += 1
                least[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.doc_id: r.component_id for r in simhash.copies(make(spark, rows)).collect()}
    assert pairs > 150 and found == {i: find(i) for i in sets}


@pytest.mark.parametrize("at_once", [1 << 18, 2000])
def test_large_groups_of_near_copies_lose_no_link(spark, monkeypatch, at_once):
    monkeypatch.setattr(nearcopies, "AT_ONCE", at_once)
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(110)], []
    for i in range(400):  # copies of one text, some near to a few others only, in lists of hundreds
        text = list(base)
        for _ in range(rng.randint(2, 4)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), "s"))
    sets = {i: nearcopies.shingles(t) for i, t, _ in rows}
    keys = {i: nearcopies.bands(s) for i, s in sets.items()}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and (keys[a] == keys[b]).any():
                least[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.doc_id: r.component_id for r in simhash.copies(make(spark, rows)).collect()}
    assert 1 < len({find(i) for i in sets}) < 400 and found == {i: find(i) for i in sets}


def test_near_copies_keep_the_links_of_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.choice("alpha beta gamma delta") + str(rng.randrange(9)) for _ in range(12)]
    rows = [(i, " ".join(base * (30 + i)) + f" a{i} b{i} c{i} d{i}", "s") for i in range(6)] + [(50, "", "s"), (51, None, "s"), (52, " \n", "s")]
    rows += [(100 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60)), "s") for i in range(30)]
    table = make(spark, rows)
    prints = {r.doc_id: r.component_id for r in simhash.classes(table).collect()}
    found = {r.doc_id: r.component_id for r in simhash.copies(table).collect()}
    sets = {i: set(nearcopies.shingles(t).tolist()) for i, t, _ in rows}
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])  # the shingles alone do not link them
    assert len({prints[i] for i in range(6)}) == 1 and found == prints


def test_workers_hand_their_memory_back():
    def one(batches):
        for batch in batches:
            seen.append(batch.num_rows)
            yield batch

    seen = []
    table = pa.table({"n": list(range(2 * common.ROWS_AT_ONCE + 5))})
    common.HELD.update({"packing": {"path": 1}, "others": {"path": 2}})
    got = pa.Table.from_batches(common.lean(one, keeps="packing")(iter(table.to_batches())))
    assert got.equals(table) and max(seen) == common.ROWS_AT_ONCE and list(common.HELD) == ["packing"]
    assert sum(b.num_rows for b in common.lean(one, None)(iter(table.to_batches()))) == len(table) == seen[-1] and not common.HELD


def test_workers_forget_what_another_stage_held(spark):
    docs = make(spark, [(i, f"some words {i}", "s") for i in range(20)]).coalesce(1)
    packing.mixed_pieces(docs).count()

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([len(common.HELD)])], ["n"])

    count = lambda: sum(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect())
    common.HELD["here"] = {"lock": (i for i in ())}  # what the driver holds does not travel
    assert count() > 0
    for _ in range(3):
        nearcopies.signatures(spark.range(64).selectExpr("id AS doc_id", "'one text' AS text").repartition(16), simhash.fingerprint).collect()
    common.HELD.clear()
    assert count() == 0


def test_freed_memory_of_near_copies_does_not_stay(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(800)), "s") for i in range(9000)]
    nearcopies.signatures(make(spark, rows).coalesce(1), simhash.fingerprint).write.format("noop").mode("overwrite").save()

    def memory(batches):
        list(batches)
        mb = sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024
        yield pa.RecordBatch.from_arrays([pa.array([mb])], ["mb"])

    most = max(r.mb for r in spark.range(0, 64, 1, 16).mapInArrow(memory, "mb double").collect())
    assert most < 90, most


def test_near_copies_of_odd_tables(spark, odd, empty):
    kept = simhash.one_of_each(odd, simhash.copies(odd))
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert simhash.one_of_each(empty, simhash.copies(empty)).count() == 0


# --- packing -----------------------------------------------------------------


def test_plans_use_every_piece_and_few_sequences():
    rng = np.random.default_rng(0)
    for n, lower in ((2000, 4), (1, 0), (50, 2)):
        counts = Counter(np.clip(rng.lognormal(5.8, 1.0, n).astype(int), 1, 2048).tolist())
        used, many = Counter(), 0
        for layout, times in packing.plan(counts):
            assert sum(layout) <= 2048 and times > 0
            many += times
            for length in layout:
                used[length] += times
        assert used == counts and many <= -(-sum(k * v for k, v in counts.items()) // 2048) + lower + 1


def test_exact_complements_come_first():
    assert packing.plan({2000: 3, 48: 3}) == [((2000, 48), 3)]
    assert packing.plan({1000: 1, 600: 1, 448: 1}) == [((1000, 600, 448), 1)]
    assert packing.plan({1000: 1, 500: 1, 300: 1, 248: 1}) == [((1000, 500, 300, 248), 1)]
    assert packing.plan({}) == []


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_the_index_finds_the_largest_complement(seed):
    """Pair and triple sums against a search through all combinations, while lengths run out."""
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 60), 18)}
    open_ = packing._Open(counts, 100)
    while open_.lengths:
        first = open_.lengths[-1]
        for gap in range(1, 100):
            for many, find in ((2, open_.pair), (3, open_.triple)):
                combos = (c for c in itertools.combinations_with_replacement(open_.lengths[::-1], many) if sum(c) == gap)
                want = next((first, *c) for c in combos if open_.times((first, *c))) if any(open_.times((first, *c)) for c in itertools.combinations_with_replacement(open_.lengths[::-1], many) if sum(c) == gap) else None
                assert find(first, gap) == want
        open_.take((rng.choice(open_.lengths),), 1)


def test_other_tokenizers_encode_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    assert packing.remembers_words(packing.default_tokenizer())
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, mine = Tokenizer.from_file(path), packing.encoder(path)
    assert not packing.remembers_words(path)
    for t in ("Two  Words\n", "don't", "ÀB c", "a <|endoftext|>"):
        assert np.frombuffer(mine(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_pack_matches_the_tokenizer(odd, odd_rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(odd, capacity=256).collect()
    want = Counter()
    for i, t, _ in odd_rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for n, a in enumerate(range(0, len(ids), 256)):
            want[key(i), n, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())] += 1
    assert Counter((key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_sequences_follow_the_mix(spark, odd, odd_rows, empty):
    plain, mixed = packing.pack(odd, capacity=256).collect(), packing.pack_mixed(odd, capacity=256).collect()
    piece = lambda r: (key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(piece, mixed)) == Counter(map(piece, plain)) and packing.pack_mixed(empty).count() == 0
    places = defaultdict(list)
    for r in mixed:
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(places) == list(range(len({r.sequence_id for r in plain})))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 256
    # a source that is wanted more comes in the first sequences, whatever its share of the rows
    rng = random.Random(3)
    docs = make(spark, [(i, " ".join(["word"] * rng.choice([20, 60, 110, 190])), "hot" if i % 10 else "rare") for i in range(3000)])
    for weights in ({"hot": 0.5, "rare": 0.5}, {"hot": 0.9, "rare": 0.1}, {"hot": 0.2, "rare": 0.8}):
        rows = packing.pack_mixed(docs, weights, capacity=256).collect()
        first = [r for r in rows if r.sequence_id < 120]  # some ten blocks
        share = sum(r.length for r in first if r.doc_id % 10 == 0) / sum(r.length for r in first)
        assert abs(share - weights["rare"]) < 0.12, (weights, share)
        where = defaultdict(list)
        for r in rows:
            where[r.length].append((r.sequence_id, r.offset, r.doc_id))
        order = {r.doc_id: r.position for r in mixing.mix(docs, weights).collect()}
        assert all([order[d] for *_, d in sorted(w)] == sorted(order[d] for *_, d in w) for w in where.values())


def test_remembered_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, mine = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(1)
    letters = "aAbé 'sSñ́İß1²½.!\t\n\x0b\x0c\x1c\x85\xa0ŉǅɏɐzZ<|>日Σς"
    texts = ["", " ", "don't I'LL x'y's 4.5", "<|endoftext|> a", "ΑΣ ΑΣ.", "́a"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(mine(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)


# --- search ------------------------------------------------------------------


def brute_search(rows, queries, k):
    """Scores in millionths of every document, each term's share rounded."""
    tf = [search.terms(t) for _, t, _ in rows]
    n, size = len(tf), [sum(c.values()) for c in tf]
    mean = sum(size) / n
    df = Counter(w for c in tf for w in c)
    out = {}
    for q, text in queries:
        found = []
        for c, s, (i, *_) in zip(tf, size, rows, strict=True):
            v = sum(round(1e6 * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * s / mean)))) for w in search.terms(text) if w in c)
            if v > 0:
                found.append((-v, i is None, i))
        out[q, hashlib.md5(text.encode()).hexdigest()] = [(i, -v / 1e6) for v, _, i in sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


def test_search_matches_brute_force(spark, odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(search, "QUERY_TERMS", 40)
    asked = [(i, t) for i, t, _ in odd_rows if i is not None and i % 100 == 0 and t]
    got = defaultdict(list)
    for r in search.top_k(odd, search.every_hundredth(odd)).orderBy("rank").collect():
        got[r.query_id, r.query_md5].append((r.doc_id, r.score))
    assert got == {q: rows for q, rows in brute_search(odd_rows, asked, 10).items() if rows}
    assert search.top_k(empty, search.every_hundredth(empty)).count() == 0


def test_equal_texts_tie_by_id_across_shards(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 2_000)
    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=rng.randint(5, 60))) for _ in range(40)]
    rows = [(i, texts[i % 40], "s") for i in range(160)]
    rng.shuffle(rows)
    asked = [(i, texts[i % 40]) for i in range(0, 160, 4)]
    df = make(spark, rows)
    queries = df.filter("doc_id % 4 = 0").selectExpr("doc_id AS query_id", "text")
    got = defaultdict(list)
    for r in search.top_k(df, queries).orderBy("rank").collect():
        got[r.query_id, r.query_md5].append((r.doc_id, r.score))
    assert got == brute_search(rows, asked, 10)
    named = df.selectExpr("concat('d', lpad(doc_id, 3, '0')) AS doc_id", "text")  # ids of any kind that sorts
    first = search.top_k(named, queries.limit(1), 4).orderBy("rank").collect()
    assert [r.doc_id for r in first] == [f"d{first[0].query_id % 40 + 40 * j:03}" for j in range(4)]


def test_empty_texts_fill_shards_by_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 50)
    df = make(spark, [(i, "" if i else "only words", "s") for i in range(400)])
    assert search.build_index(df).df.count() >= 6
    assert [(r.doc_id, r.rank) for r in search.top_k(df, search.every_hundredth(df)).collect()] == [(0, 1)]


def test_alike_documents_share_blocks_and_tie_by_id(monkeypatch):
    monkeypatch.setattr(search, "GROUPS", 8)
    rng = random.Random(6)
    kinds = [[f"{c}{i}" for i in range(20)] for c in "abcd"]
    of = np.array([rng.randrange(4) for _ in range(1200)])
    of[::40] = of[0]
    texts = [" ".join(rng.sample(kinds[k], 12)) for k in of.tolist()]
    for i in range(40, 1200, 40):
        texts[i] = texts[0]
    batch = pa.table({"doc_id": range(1200), "text": texts}).to_batches()
    (out,) = search._index(iter(batch))
    shard = search.Shard({c: out.column(c)[0].as_py() for c in out.schema.names if c != "ids"}, 12.0)
    ids = np.array(out.column("ids")[0].as_py())
    assert sorted(ids.tolist()) == list(range(1200))
    blocks = [of[ids[at : at + search.BLOCK]] for at in range(0, 1200, search.BLOCK)]
    assert sum(len(set(b.tolist())) == 1 for b in blocks) >= len(blocks) // 2
    asked = np.array([search.term_hash(t) for t in texts[0].split()], np.int64)
    docs, scores = shard.search(asked, np.ones(len(asked)), 10)
    best = sorted(zip((-scores).tolist(), ids[docs].tolist(), strict=True))
    assert [i for _, i in best] == list(range(0, 400, 40)) and len({s for s, _ in best}) == 1


def test_pruning_changes_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    n = 900
    docs = [Counter(rng.zipf(1.3, 60).clip(max=400).tolist()) for _ in range(n)]
    vocab = sorted({w for d in docs for w in d})
    post = defaultdict(list)
    for i, d in enumerate(docs):
        for w, c in d.items():
            post[w].append((i, c))
    row = {
        "terms": np.array(vocab, np.int64).tobytes(), "df": np.array([len(post[w]) for w in vocab], np.int64).tobytes(),
        "docs": np.array([i for w in vocab for i, _ in post[w]], np.uint32).tobytes(), "tf": np.array([c for w in vocab for _, c in post[w]], np.uint32).tobytes(),
        "lengths": np.array([sum(d.values()) for d in docs], np.uint32).tobytes(),
    }
    shard = search.Shard(row, 60.0)
    assert (shard.row >= 0).any()
    for q in range(0, n, 45):
        terms = np.array(list(docs[q]), np.int64)
        weights = np.array([math.log(1 + n / len(post[w])) for w in terms.tolist()])
        docs_, scores = shard.search(terms, weights, 10)
        every, all_scores = shard.search(terms, weights, n)
        order = np.lexsort((every, -all_scores))[:10]
        mine = np.lexsort((docs_, -scores))
        assert docs_[mine].tolist() == every[order].tolist() and scores[mine].tolist() == all_scores[order].tolist()
        floor = int(all_scores[order][4])
        fewer, their = shard.search(terms, weights, 10, floor)
        assert sorted(fewer.tolist()) == sorted(every[order][all_scores[order] >= floor].tolist()) and (their >= floor).all()
