"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks.  With target weight w, block j of a source is
released at floor((j-1)/w) and due at ceil(j/w), in units of one block; earliest
deadline first among the released blocks keeps every source within one block
of its share at every prefix of the mix.

Weights are taken as the exact fractions that the floats stand for, so nothing
is rounded however long the mix is; the driver keeps 12 bytes a block, of
MOST_BLOCKS blocks at most.  When a source runs dry a new phase begins, with the weights of the others scaled up;
no row is dropped or repeated.  Where a number of quanta is asked for, weights
are rounded to multiples of 1/quanta instead, and one period is tiled.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread_rank, text_key

#: Rows of a block at least, and blocks of a plan at most: beyond BLOCK * MOST_BLOCKS rows blocks grow, so that the
#: plan, which is worked out on the driver and broadcast, stays below 12 MB.
BLOCK = 32
MOST_BLOCKS = 1 << 20
#: Slots of a period where weights are rounded to multiples of 1/quanta.
QUANTA = 1024
#: Blocks of a source whose slots travel in one row.
CHUNK = 1024
#: Sources the driver plans for; a plan has one row per source and phase.
MAX_SOURCES = 512


def quantize(weights: Mapping[str, float], quanta: int = QUANTA) -> dict[str, int]:
    """Positive integer shares that sum to ``quanta``, by largest remainder."""
    total = float(sum(weights.values()))
    exact = {s: w / total * quanta for s, w in weights.items()}
    share = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s))
    i = 0
    while sum(share.values()) < quanta:
        share[order[i % len(order)]] += 1
        i += 1
    while sum(share.values()) > quanta:
        share[max(share, key=lambda s: (share[s], s))] -= 1
    return share


def period(share: Mapping[str, int], quanta: int = QUANTA) -> list[str]:
    """Who gets each slot of one period: earliest deadline first among released blocks."""
    waiting = [(0, s, 1) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(quanta):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * quanta // share[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if due < t + 1:
            raise AssertionError("a block missed its deadline")
        out.append(s)
        if j < share[s]:
            heapq.heappush(waiting, (j * quanta // share[s], s, j + 1))
    return out


def plan_phases(blocks: Mapping[str, int], weights: Mapping[str, float], quanta: int = QUANTA) -> list[dict]:
    """One entry per phase and source: source, phase, first_block, n_blocks, share, base, at.

    ``at`` lists the slots of one period that the source holds; its block
    first_block + i sits in slot base + (i div share) * quanta + at[i mod share].
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    base, phase, out = 0, 0, []
    while left:
        share = quantize({s: weights[s] for s in left}, quanta)
        slots = period(share, quanta)
        at: dict[str, list[int]] = {s: [] for s in left}
        for t, s in enumerate(slots):
            at[s].append(t)
        rounds = min(left[s] // share[s] for s in left)
        taken = {s: rounds * share[s] for s in left}
        used = rounds * quanta
        if all(taken[s] < left[s] for s in left):
            for s in slots:
                taken[s] += 1
                used += 1
                if taken[s] == left[s]:
                    break
        for s in left:
            if taken[s]:
                out.append({"source": s, "phase": phase, "first_block": done[s], "n_blocks": taken[s], "share": share[s], "base": base, "at": at[s]})
            done[s] += taken[s]
        left = {s: n - taken[s] for s, n in left.items() if n > taken[s]}
        base += used
        phase += 1
    return out


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Integers in the exact proportions of the weights; sources of weight 0 only where there are no others, all alike."""
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0} or dict.fromkeys(weights, Fraction(1))
    scale = math.lcm(*(f.denominator for f in exact.values()))
    return {s: int(f * scale) for s, f in exact.items()}


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, tuple[array, array]]:
    """(slots, phases) of each source's blocks in their order, under the exact weights."""
    left = {s: n for s, n in blocks.items() if n > 0}
    out = {s: (array("q"), array("i")) for s in left}
    base = phase = 0
    while left:
        whole = whole_weights({s: weights[s] for s in left})
        total = sum(whole.values())
        waiting = [(0, s, 1) for s in sorted(whole)]
        ready: list[tuple[int, str, int]] = []
        t = 0
        while True:
            while waiting and waiting[0][0] <= t:
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-j * total // whole[s]), s, j))
            due, s, j = heapq.heappop(ready)
            t += 1
            if due < t:
                raise AssertionError("a block missed its deadline")
            out[s][0].append(base + t - 1)
            out[s][1].append(phase)
            left[s] -= 1
            if not left[s]:
                break
            heapq.heappush(waiting, (j * total // whole[s], s, j + 1))
        del left[s]
        base += t
        phase += 1
    return out


def rounded_schedule(blocks: Mapping[str, int], weights: Mapping[str, float], quanta: int) -> dict[str, tuple[array, array]]:
    """What ``schedule`` gives, under weights rounded to multiples of 1/quanta."""
    out = {s: (array("q"), array("i")) for s, n in blocks.items() if n > 0}
    for p in plan_phases(blocks, weights, quanta):
        slots, phases = out[p["source"]]
        slots.extend(p["base"] + i // p["share"] * quanta + p["at"][i % p["share"]] for i in range(p["n_blocks"]))
        phases.extend([p["phase"]] * p["n_blocks"])
    return out


def temperature_weights(rows: Mapping[str, int], exponent: float = 0.5) -> dict[str, float]:
    """Target weights proportional to rows ** exponent."""
    return {s: float(n) ** exponent for s, n in rows.items()}


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block: int | None = None,
    quanta: int | None = None,
    exponent: float = 0.5,
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """The place of every row in the mix.

    Returns doc_id, source, block (in its source), slot, phase, position
    (gapless from 0 over all rows), target_weight, and the ``payload`` columns.
    ``weights`` maps each source to its target; a missing source gets the
    smallest of them; without any, weights follow rows ** ``exponent``.
    ``quanta`` rounds the weights to its multiples; without it they are exact.
    A block has ``block`` rows, without it BLOCK, or more in tables of over
    BLOCK * MOST_BLOCKS rows.

    A null source is a source of its own; null or repeated doc_ids keep their
    rows; texts, however long, only break ties; an empty table gives no rows;
    other columns, whatever their names, stay out unless they are payload; more
    than 512 sources, and negative or infinite weights, raise ValueError.
    """
    kept = [F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(payload)]  # a payload may share a name with the plan
    placed = place(docs.select("doc_id", "source", *text_key(), *kept), weights, block, quanta, exponent)
    names = ("doc_id", "source", "block", "slot", "phase", "position", "target_weight")
    return placed.select(*names, *[F.col(f"_p{i}").alias(c) for i, c in enumerate(payload)])


def place(
    rows: DataFrame, weights: Mapping[str, float] | None = None, block: int | None = None, quanta: int | None = None, exponent: float = 0.5
) -> DataFrame:
    """Rows (doc_id, source, the text's key k1 and k2, any others) with their block, slot, phase, position and target_weight."""
    spark = rows.sparkSession
    null_name = "\0null"
    rows = rows.withColumn("_src", F.coalesce(F.col("source").cast("string"), F.lit(null_name)))
    counts = {r["_src"]: r["n"] for r in rows.groupBy("_src").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    block = block or max(BLOCK, -(-sum(counts.values()) // (MOST_BLOCKS - MAX_SOURCES)))
    if weights is None:
        target = temperature_weights(counts, exponent)
    else:
        target = {s: float(weights.get(s, min(weights.values()))) for s in counts}
    n_blocks = {s: -(-n // block) for s, n in counts.items()}
    if quanta is None:
        found = schedule(n_blocks, target)
    else:
        found = rounded_schedule(n_blocks, target, max(quanta, 1 << max(1, (4 * len(counts) - 1).bit_length())))
    total = sum(target.values()) or 1.0
    gaps = [(slots[-1], -counts[s] % block) for s, (slots, _) in found.items() if counts[s] % block]
    schema = "_s string, _chunk long, _slots array<long>, _phases array<int>, target_weight double"
    chunks = spark.createDataFrame(
        [
            (s, at // CHUNK, slots[at : at + CHUNK].tolist(), phases[at : at + CHUNK].tolist(), target[s] / total)
            for s, (slots, phases) in found.items() for at in range(0, len(slots), CHUNK)
        ],
        schema,
    )
    ranked = spread_rank(rows, ["_src"], ["doc_id", "k1", "k2"], "_rank")
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block).cast("long"))
    here = (F.col("_src") == F.col("_s")) & (F.floor(F.col("block") / CHUNK) == F.col("_chunk"))
    nth = (F.col("block") % CHUNK + 1).cast("int")
    missing = F.lit(0).cast("long")
    if gaps:
        table = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(n).cast("long").alias("n")) for s, n in gaps])
        missing = F.aggregate(table, F.lit(0).cast("long"), lambda a, g: a + F.when(g["s"] < F.col("slot"), g["n"]).otherwise(F.lit(0)))
    others = [c for c in rows.columns if c not in ("_src", "source")]
    return (
        ranked.join(F.broadcast(chunks), here)  # 12 bytes a block
        .withColumn("slot", F.element_at("_slots", nth))
        .select(
            *others, F.when(F.col("_src") != null_name, F.col("_src")).alias("source"), "block", "slot", F.element_at("_phases", nth).alias("phase"),
            (F.col("slot") * block + F.col("_rank") % block - missing).cast("long").alias("position"), "target_weight",
        )
    )


def mixed_documents(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The documents, all columns, partitioned and sorted in the order of the mix.

    Null, empty and very long texts, null sources, repeated rows and columns of
    any name stay as they are; an empty table gives no rows.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "source")]
    # carried columns travel under numbers, as they may share a name with the plan's
    named = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carried)])
    placed = mix(named, weights, payload=tuple(f"__c{i}" for i in range(len(carried))))
    ordered = placed.repartitionByRange("position").sortWithinPartitions("position")
    back = {c: F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)}
    return ordered.select(*[back.get(c, F.col(c)) for c in docs.columns])
