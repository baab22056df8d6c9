import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns under names that operators use themselves.
CLASHING = ("k1", "k2", "fp", "root", "score", "position", "block", "slot", "shard", "length", "rank", "label", "kept", "_rank", "_src")


def make(spark, rows, clashing=False):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})
    return df


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta stone river cloud light paper green seven eight north south lemon".split()) + rng.choice("abcdefghij") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(3, 160)) for _ in range(25)]
    passage = words(rng, 90)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "hot") for i in range(30)]
    rows += [(200 + i, base[1 + i] + f" end{i}", "s1") for i in range(5)]
    rows += [(300 + i, f"{words(rng, 12)} {passage} {words(rng, 9)}", "s2") for i in range(4)]
    rows += [(400, None, None), (401, "", "s0"), (402, " \n\t ", None), (None, "no id here at all", "s0"), (None, None, None), (403, "ünï çödé " * 80, "s0"), (404, "x" * 3000, "s0"), (405, words(rng, 30_000), "s1")]
    rows += [(7, base[7], "s1"), (7, "another text under a used id", "s2"), (500, "one", "s0"), (501, "Two words", "s0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows, clashing=True).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [], clashing=True)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(i, k % 2, k % 3 == 0) for k, (i, *_) in enumerate(odd_rows)]
    return spark.createDataFrame([(i, q, int(t)) for i, q, t in rows] + [(3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
