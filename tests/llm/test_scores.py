"""Operators that look at each document: classifiers, media, licences; and the pipeline."""

import hashlib
import math
import random
import struct
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from resona.llm import labelled, licenses, media, quality, queries, toxicity

from .conftest import make


def key(i):
    return -1 if i is None else i


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# --- labels ------------------------------------------------------------------


def test_training_rows_leave_out_the_held_out_fold(odd, labels):
    rows = labelled.training_rows(odd, labels, "quality", 5, 0, 10_000).collect()
    assert rows and all(fold(r.doc_id, 5) != 0 for r in rows)
    few = labelled.training_rows(odd, labels, "quality", 5, 0, 8).collect()
    assert len(few) < len(rows)


def test_repeated_ids_give_one_training_row(spark):
    docs = make(spark, [(7, f"text {i % 50}", "s") for i in range(400)] + [(8, None, "s")])
    rows = labelled.training_rows(docs, spark.createDataFrame([(7, 1), (8, 0), (8, 0)], "doc_id long, quality int"), "quality", 5, 9, 100).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(7, 1), (8, 0)] and {r.text for r in rows if r.doc_id == 8} == {""}


# --- quality -----------------------------------------------------------------


def junk(rng, good):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in good.split())
    if kind == 1:
        return " | ".join(good.split())
    return (good.split()[0] + " ") * 60


@pytest.fixture(scope="module")
def graded(spark):
    from .conftest import words

    rng = random.Random(9)
    rows, graded = [], []
    for i in range(300):
        text = words(rng, rng.randint(20, 120))
        bad = i % 4 == 0
        rows.append((i, junk(rng, text) if bad else text, "s"))
        graded.append((i, int(not bad), 0))
    return make(spark, rows), spark.createDataFrame(graded, "doc_id long, quality int, toxic int")


def test_quality_holds_out(graded):
    docs, labels = graded
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    right = Counter()
    for r in rows:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out:
            right[r.predicted == int(r.doc_id % 4 != 0)] += 1
    assert right[True] > 0.95 * (right[True] + right[False])


def test_quality_of_odd_tables(odd, odd_rows, empty, labels):
    ranker = quality.train(odd, labels)
    rows = quality.score(odd, ranker).collect()
    assert Counter(key(r.doc_id) for r in rows) == Counter(key(i) for i, *_ in odd_rows)
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0
    kept = quality.kept_documents(odd, labels)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.predicted for r in rows)


def dense_rows(x, shares=None):
    """Training rows of measures, and of a table of shares."""
    shares = np.zeros((len(x), 1)) if shares is None else shares
    at = [np.flatnonzero(r) for r in shares]
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int64)
    return quality.Rows(np.asarray(x, float), bounds, np.concatenate([*at, np.zeros(0, int)]).astype(np.int32), np.concatenate([*[r[a] for r, a in zip(shares, at, strict=True)], np.zeros(0)]))


def test_pairs_recover_the_direction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > -0.8).astype(int)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = quality.fit_pairs(dense_rows(x), rng.choice(good, 5000), rng.choice(bad, 5000), width=1)
    assert w[0] > 5 * abs(w[1:]).max()
    neutral = quality.fit(dense_rows(np.zeros((3, len(quality.NAMES)))), np.ones(3))
    assert neutral.score([None, "a text"]).min() > quality.CUT


def test_the_fit_is_the_least_loss(monkeypatch):
    """Against plain Newton steps on the differences of the pairs' whole rows; rows without any share among them."""
    monkeypatch.setattr(quality, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(quality, "SHARES", 1.0)
    rng = np.random.default_rng(14)
    x, shares = rng.normal(size=(60, 2)), rng.random((60, 7)) * (rng.random((60, 7)) < 0.4)
    shares[::9] = 0
    better, worse = rng.integers(0, 30, 500), rng.integers(25, 60, 500)
    whole = np.concatenate([x, shares], axis=1)
    d, w = whole[better] - whole[worse], np.zeros(9)
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / 500 + 0.01 * np.eye(9), -(d * p[:, None]).mean(axis=0) + 0.01 * w)
    assert quality.fit_pairs(dense_rows(x, shares), better, worse, width=7, ridge=0.01, steps=300) == pytest.approx(w, abs=2e-3)


def test_shares_are_of_the_whole_text(monkeypatch):
    text = "Ab cd ab, éé " * 400
    buckets, values = quality.shares(text)
    raw = text.lower().encode()
    grams = Counter(raw[i : i + 3] for i in range(len(raw) - 2))
    mine = {int(b): float(v) for b, v in zip(buckets, values, strict=True)}
    assert sum(v * v for b, v in mine.items() if b < quality.WORD_BUCKETS) == pytest.approx(1, abs=0.01)
    want = Counter()
    for g, n in grams.items():
        want[quality.WORD_BUCKETS + ((int.from_bytes(g, "big") * 2654435761 & 0xFFFFFFFF) >> 23)] += n / (len(raw) - 2)
    assert {b: v * v for b, v in mine.items() if b >= quality.WORD_BUCKETS} == pytest.approx(dict(want), rel=0.01)
    monkeypatch.setattr(quality, "PIECE", 100)
    again = quality.shares(text)
    assert (again[0] == buckets).all() and (again[1] == values).all()
    assert all(len(x) == 0 for t in (None, "", " \n") for x in quality.shares(t))


def test_words_that_the_measures_do_not_see_are_learnt(spark):
    """Good and bad texts that differ in a few words only."""
    from .conftest import words

    rng = random.Random(41)
    rows, graded = [], []
    for i in range(400):
        text = words(rng, 60).split()
        bad = i % 3 == 0
        for _ in range(6):
            text[rng.randrange(60)] = rng.choice(["meadowa", "harbourb", "valleyc"] if bad else ["summita", "islandb", "forestc"])
        rows.append((i, " ".join(text), "s"))
        graded.append((i, int(not bad), 0))
    docs = make(spark, rows)
    found = quality.score(docs, quality.train(docs, spark.createDataFrame(graded, "doc_id long, quality int, toxic int"))).filter("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in found) > 0.95 * len(found)


# --- toxicity ----------------------------------------------------------------


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition: the best one, then either side of it."""

    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (found is None or total > found[2] + 1e-9):
                    found = (i, j + 1, total)
        return found

    out = []

    def split(a, b):
        f = best(a, b)
        if f:
            split(a, f[0])
            out.append(f)
            split(f[1], b)

    split(0, len(scores))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_segments_match_the_definition(seed):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.normal(-0.2, 1.0, 40), 3)
    got, want = toxicity.segments(scores), brute_segments(scores.tolist())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_karlin_root():
    values, chances = np.array([1.0, -1.0]), np.array([0.25, 0.75])
    assert toxicity.karlin(values, chances) == pytest.approx(np.log(3))
    assert toxicity.karlin(-np.abs(values), chances) == 1.0


def brute_joint(lone, log_length):
    """The joint evidence written out: for each number of best segments, the chance of their sum."""
    if not len(lone):
        return max(-toxicity.SATURATED, -log_length)
    found = [max(lone)]
    good = sorted((x for x in lone if x > 0), reverse=True)
    for r in range(2, len(good) + 1):
        t = sum(good[:r])
        if t >= r:
            chance = math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) * 2 ** (r - 1)
            found.append(-math.log(chance))
    return min(toxicity.SATURATED, max(found))


@pytest.mark.parametrize("seed", range(5))
def test_joint_evidence_matches_its_law(seed):
    rng = np.random.default_rng(100 + seed)
    for n in range(12):
        lone = rng.normal(0.5, 2.0, n)
        assert toxicity.joint_evidence(lone, 4.0) == pytest.approx(brute_joint(lone.tolist(), 4.0))


def test_chance_seldom_reaches_the_joint_evidence():
    """In random texts, evidence of e or more is about as rare as exp(-e)."""
    rng = np.random.default_rng(8)
    values, chances = np.array([2.0, -1.0]), np.array([0.15, 0.85])
    detector = toxicity.Detector({}, 0.0, toxicity.karlin(values, chances), 1.0, 0.0)
    found = np.array([detector.weigh(rng.choice(values, 400, p=chances))[0] for _ in range(4000)])
    for e in (2.0, 3.0, 4.0):
        assert (found >= e).mean() < 2 * math.exp(-e)


def test_several_passages_count_together():
    detector = toxicity.Detector({"vile": 5.5}, 0.05, 1.0, 1.0, 0.0)
    far = " ".join(["plain"] * 300)
    one, two, five = (detector.weigh(detector.token_scores(far.join([" vile vile "] * n) + far * (6 - n), {})) for n in (1, 2, 5))
    assert one[0] < two[0] < five[0] and not five[1]  # none is significant alone
    long_ = detector.weigh(detector.token_scores(far + " vile" * 6 + f" {far} {far} {far}" + " vile" * 7 + " " + far, {}))
    assert [(b - a) for a, b, _ in long_[1]] == [6, 7]


def test_toxicity_holds_out(spark):
    from .conftest import words

    rng = random.Random(5)
    rows, truth = [], []
    for i in range(400):
        text = words(rng, rng.randint(30, 90)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vilest", "rottenword", "rottenthing"]))
        rows.append((i, " ".join(text), "s"))
        truth.append((i, 1, int(bad)))
    docs = make(spark, rows)
    detector = toxicity.train(docs, spark.createDataFrame(truth, "doc_id long, quality int, toxic int"))
    found = toxicity.score(docs, detector).collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) > 0.95 * len(held)
    assert all(r.n_passages == len(r.passages) for r in found) and sum(r.n_passages > 0 for r in found if r.doc_id % 5 == 0) > 60
    spans = detector.passages(rows[0][1])
    assert spans and all(any(w in ("vilest", "rottenword", "rottenthing") for w in rows[0][1].split()[a:b]) for a, b, _ in spans)


def test_toxicity_of_odd_tables(odd, odd_rows, empty, labels):
    rows = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert Counter(key(r.doc_id) for r in rows) == Counter(key(i) for i, *_ in odd_rows)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


# --- media -------------------------------------------------------------------


def test_media_round_trip(odd, odd_rows, empty):
    rows = media.media_features(odd).collect()
    want = Counter()
    for i, t, _ in odd_rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want[key(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter((key(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    same = {}
    for r in rows:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert media.media_features(empty).count() == 0


def test_images_are_lossless_and_checked():
    payload = bytes(range(256)) * 9
    stored = media.encode_image(payload)
    assert media.decode_image(stored) == payload and stored[:4] == b"\x89PNG"
    for bad in (b"x" + stored[1:], stored[:60] + b"\0" + stored[61:]):
        with pytest.raises((ValueError, struct.error)):
            media.decode_image(bad)


def test_byte_ranges_cover_each_member_once(spark, odd, odd_rows, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.store(odd, path)
    for size in (700, 5_000, 1 << 30):
        got = media.load(spark, path, size).collect()
        assert Counter((key(r.doc_id), r.n_bytes) for r in got) == Counter((key(i), len((t or "").encode())) for i, t, _ in odd_rows)


def test_uncommitted_archives_are_not_read(spark, odd, odd_rows, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.store(odd, path)
    files = sorted((tmp_path / "archives").glob("*.bin"))
    (tmp_path / "archives" / "media-000099-7.bin").write_bytes(files[0].read_bytes())
    assert media.load(spark, path).count() == len(odd_rows)


def test_members_are_retried_by_offset(tmp_path, monkeypatch):
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    data = bytes(range(200))
    (tmp_path / "a.bin").write_bytes(data)
    opened = []

    class Flaky:
        def __init__(self, fail):
            self.fail = fail

        def seek(self, at):
            self.at = at

        def read(self, n):
            if self.fail == "error":
                raise OSError("lost")
            got = data[self.at : self.at + n]
            return got[:-1] if self.fail == "short" else b"\0" * n if self.fail == "damaged" else got

    plan = iter(["error", "short", "damaged", None, None])

    def opener(path):
        opened.append(path)
        return Flaky(next(plan))

    archive = media.Archive(f"file://{tmp_path}/a.bin", opener)
    assert archive.read(10, 5, zlib.crc32(data[10:15])) == data[10:15] and len(opened) == 4
    assert archive.read(50, 5) == data[50:55] and len(opened) == 4  # the next member goes on with the file that works
    broken = media.Archive("file:///x", lambda p: Flaky("short"))
    with pytest.raises(OSError, match="member at 3"):
        broken.read(3, 4)


# --- licences ----------------------------------------------------------------


def confirmed(text):
    return [(v.license, text[a:b]) for a, b, v in licenses.notices(text) if v.confirmed]


def test_every_template_is_recognised():
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            ((a, b, v),) = licenses.notices(t)
            assert (v.license, v.words_lost, v.words_added, v.changes, v.confirmed) == (name, 0, 0, "", True) and t[a:b].split()[0] == t.split()[0], t
            assert v.saving == max(s for s, _ in licenses.rank(t[a:b])) > 0.4


def test_blocks_and_near_wordings():
    text = "prose here\nReleased under the MIT License.\nmore prose\nCopyright 2020 Someone\nDistributed under the Apache License, Version 2.0.\nend"
    found = [(v.license, text[a:b], v.changes, v.confirmed) for a, b, v in licenses.notices(text)]
    assert found == [("MIT", "Released under the MIT License", "", True), (found[1][0], "Copyright 2020 Someone", found[1][2], False), ("Apache-2.0", "under the Apache License, Version 2.0", "-licensed", True)]
    (other,) = licenses.notices("A driving licence is required to rent the car.")
    assert not other[2].confirmed
    assert confirmed("This work is licensed under the GNU General Public License, version 2.")[0][0] == "GPL-2.0"


@pytest.mark.parametrize("text", [
    "This work is not licensed under the MIT License.", "It was never\nlicensed under the MIT License.", "This work is not licensed under the GNU General Public License, version 3.",
    "Licensed under the GNU Library General Public License, version 7.", "Licensed under CC BY 3.0.", "Licensed under the MPL License.", "Licensed under the MIT Apache License.",
    "Permission is hereby granted to park here.", "This work is licensed under the GNU General Public License, version 30.",
])
def test_other_wordings_are_not_confirmed(text):
    assert confirmed(f"{text} And so on.") == [] and licenses.notices(text)


def test_siblings_are_told_apart():
    """Among templates that fit, the one that saves most wins; what a sibling has more rules a template out."""
    two, three = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][1]
    numbered = lambda t: t.replace("met: Redis", "met:\n1. Redis").replace("disclaimer. Redis", "disclaimer.\n2. Redis").replace("distribution. Neither", "distribution.\n3. Neither")
    isc, zero = licenses.TEMPLATES["ISC"][1], licenses.TEMPLATES["0BSD"][0]
    for name, text in (("BSD-2-Clause", two), ("BSD-3-Clause", three), ("BSD-2-Clause", numbered(two)), ("BSD-3-Clause", numbered(three)), ("ISC", isc), ("0BSD", zero)):
        assert [n for n, _ in confirmed(f"Copyright (c) 2019, A Holder\n\n{text}\n\nThe end of it.")] == [name]
    for small, large in (("GPL-3.0", "LGPL-3.0"), ("GPL-3.0", "AGPL-3.0"), ("CC-BY-4.0", "CC-BY-SA-4.0"), ("CC-BY-4.0", "CC-BY-NC-4.0")):
        for n in (small, large):
            for t in licenses.TEMPLATES[n]:
                assert [x for x, _ in confirmed(t)] == [n]


def test_changed_words_are_spelled_out():
    """Words lost and added against a plain longest-common-subsequence count."""
    rng = random.Random(20)
    for name in ("MIT", "BSD-3-Clause", "Zlib", "Apache-2.0"):
        t = licenses.TEMPLATES[name][-1]
        words = t.split()
        at = sorted(rng.sample([i for i, w in enumerate(words) if w.isalpha() and w.islower() and 3 < i < len(words) - 3], 5), reverse=True)
        changed = list(words)
        for i in at[:3]:
            changed[i] = f"zz{i}"
        del changed[at[4]]
        changed.insert(at[3], "extra")
        ((_, _, v),) = licenses.notices(" ".join(changed))
        assert (v.license, v.words_lost, v.words_added, v.confirmed) == (name, 4, 4, True)
        assert all(f"zz{i}" in v.changes for i in at[:3]) and "+extra" in v.changes


def test_long_lines_are_quick_and_whole():
    """A line of a megabyte, with notices at its ends and where pieces meet, takes about a second."""
    rng = random.Random(21)
    prose = [rng.choice("meadow river seldom house license of under the stone".split()) for _ in range(170_000)]
    plain = [w if w != "license" else "tree" for w in prose]
    t = licenses.TEMPLATES["MIT"][3]
    text = " ".join([t, *plain[:100_000], "Licensed under CC0 1.0.", *plain[100_000:], t])
    began = time.process_time()
    assert [n for n, _ in confirmed(text)] == ["MIT", "CC0-1.0", "MIT"] and time.process_time() - began < 2
    dense = [*prose[:20_000]]
    for at in range(1500, 20_000, 2048):
        dense[at] = "Licensed under the Apache License, Version 2.0."
    assert [n for n, _ in confirmed(" ".join(dense))].count("Apache-2.0") == len(range(1500, 20_000, 2048))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices_are_whole(mark):
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            lines = textwrap.wrap(t, 72 - len(mark))
            text = "\n".join(["Some prose stands before it.", "", *[mark + line for line in lines], "", "And some after, to the end."])
            found = confirmed(text)
            assert [n for n, _ in found] == [name], (text, found)
            assert found[0][1].split()[0] == t.split()[0].strip("'") and found[0][1].split()[-1].strip(".:/") == t.split()[-1].strip(".:/")


def test_no_template_is_ruled_out_by_its_compression():
    rng = random.Random(2)
    common = " ".join(x for texts in licenses.TEMPLATES.values() for t in texts for x in t.split() if len(x) < 8).split()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for n in (100, 900):
                prose = [rng.choice(["meadow", "river", "seldom", "house", *rng.choices(common, k=2)]) for _ in range(n)]
                text = " ".join([*prose[: n // 2], t, *prose[n // 2 :]])
                assert name in [x for x, _ in confirmed(text)], (name, text)


def test_every_notice_of_a_block_has_its_row(spark):
    a, b = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    for text in (f"{a}\n{b}", f"{b} {a}", f"x\n{a} Or at your option: {b}\ny", f"{a}\n\n{b}"):
        assert sorted(n for n, _ in confirmed(text)) == ["Apache-2.0", "MIT"], text
    assert [n for n, _ in confirmed(" ".join([a, b] * 20))] == ["MIT", "Apache-2.0"] * 20
    rows = licenses.scan(make(spark, [(1, f"{a}\n{b}\nLicensed to drive a car.", "s")])).collect()
    assert [(r.block, r.license, r.confirmed) for r in rows][:2] == [(0, "MIT", True), (1, "Apache-2.0", True)] and [r.confirmed for r in rows[2:]] == [False]


def test_licenses_of_odd_tables(spark, odd, empty):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    rows = [(1, "a\nReleased under the MIT License.", "s"), (1, "a\nReleased under the MIT License.", "s"), (2, "b " * 50_000 + "\nLicensed under CC BY-NC 4.0.\n" + "c " * 10, "s"), (None, None, None)]
    found = licenses.scan(make(spark, rows, clashing=True)).collect()
    assert sorted((r.doc_id, r.license, r.confirmed, r.start) for r in found) == [(1, "MIT", True, 2), (1, "MIT", True, 2), (2, "CC-BY-NC-4.0", True, 100_001)]


# --- queries and pipeline ----------------------------------------------------


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, small):
    import corpus_pipeline as pipeline

    assert [s for s, _ in pipeline.STAGES] == ["quality classifier", "near duplicates", "repeated passages", "source mix", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    now, counts = docs, [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, small)
        assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes)
        now = spark.createDataFrame(now.collect(), docs.schema)
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    staged = pipeline.STAGES[-1][1](spark, now, small)
    ids = {r.doc_id for r in staged.collect()}
    assert ids == {r.doc_id for r in now.collect()}
    whole = pipeline.run(spark, small)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, staged.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_the_mix_reaches_the_sequences(spark, small, monkeypatch):
    import corpus_pipeline as pipeline

    found = {}
    sources = [r.source for r in spark.read.parquet(f"{small}/documents.parquet").select("source").distinct().orderBy("source").collect()]
    for wanted in (sources[0], sources[-1]):
        monkeypatch.setattr(pipeline, "WEIGHTS", dict.fromkeys(sources, 1.0) | {wanted: 50.0})
        found[wanted] = {(r.doc_id, r.piece, r.ids_crc32): (r.sequence_id, r.offset) for r in pipeline.run(spark, small).collect()}
    a, b = found.values()
    assert a.keys() == b.keys() and a != b
