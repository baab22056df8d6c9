"""Sharding by fixed virtual slots, in DataFrame operations only.

Records hash into a fixed number of virtual slots; bytes are summed per slot;
a versioned slot-to-shard map says where each slot lives.  Rebalancing never
touches the hash: it edits the map, moving the fewest heavy slots from shards
above the mean to the lightest ones, and stores the edit as the next version.
A folder that the caller names keeps all versions; the newest complete one holds,
and a run that moves nothing leaves it as it is.

The slot table has ``slots`` rows whatever the size of the input, so it is the
one thing that is folded in a single row and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, scratch, whole_text

#: Virtual slots; fixed for the life of a data set, far above any shard count.
SLOTS = 4096
#: What a record costs besides its text.
OVERHEAD = 16


def slot_of(id_column: Column, payload_crc: Column, slots: int = SLOTS) -> Column:
    """The record's virtual slot: by its id, or by its content where the id is null."""
    return F.pmod(F.xxhash64(F.coalesce(id_column.cast("string"), payload_crc.cast("string"))), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each record; the text goes no further."""
    raw = whole_text().cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    ).withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def slot_bytes(records: DataFrame) -> DataFrame:
    """Rows and bytes of each used slot (partial sums before the shuffle)."""
    return records.groupBy("vslot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt round robin."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard")
    )


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` for the measured ``loads``.

    A shard keeps its heaviest slots while their sum stays within the mean;
    the others are released and go, heaviest first, to the shard that is
    lightest by then.  Slots without load stay.  ``shards`` may differ from
    the map's: slots of shards that are gone are released.
    """
    weighed = slot_map.join(F.broadcast(loads.select("vslot", "slot_bytes")), "vslot", "left").fillna(0, ["slot_bytes"])
    mean = weighed.agg((F.sum("slot_bytes") / F.lit(shards)).alias("mean"))
    upto = Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "vslot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        weighed.withColumn("running", F.sum("slot_bytes").over(upto))
        .join(F.broadcast(mean))
        .withColumn("kept", (F.col("shard") < shards) & ((F.col("running") <= F.col("mean")) | (F.col("slot_bytes") == 0)))
    )
    one = marked.agg(
        (F.max("version") + 1).alias("version"),
        F.sort_array(F.collect_list(F.when(~F.col("kept"), F.struct((-F.col("slot_bytes")).alias("minus"), "vslot")))).alias("free"),
        F.collect_list(F.when(F.col("kept"), F.struct("vslot", "shard", "slot_bytes"))).alias("kept"),
    )
    start = F.expr(
        f"transform(sequence(0, {shards - 1}), s -> aggregate(filter(kept, k -> k.shard = s), 0L, (a, k) -> a + k.slot_bytes))"
    )
    # the fold's state: what each shard holds, and where each released slot went
    dealt = F.expr(
        """aggregate(free,
             named_struct('loads', start, 'to', cast(array() as array<int>)),
             (st, x) -> named_struct(
               'loads', transform(st.loads, (v, i) -> if(i = array_position(st.loads, array_min(st.loads)) - 1, v - x.minus, v)),
               'to', concat(st.to, array(cast(array_position(st.loads, array_min(st.loads)) - 1 as int)))),
             st -> st.to)"""
    )
    one = one.withColumn("start", start).withColumn("to", dealt)
    moved = F.expr("transform(free, (x, i) -> named_struct('vslot', x.vslot, 'shard', to[i], 'slot_bytes', -x.minus))")
    return one.select("version", F.explode(F.concat("kept", moved)).alias("m")).select("version", "m.vslot", "m.shard")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions of the map that are complete in the folder, oldest first."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    names = [s.getPath().getName() for s in system.listStatus(top)]
    return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-") and system.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map (version, vslot, shard), the newest unless named."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version or 'of the map'} in {folder}")
    return spark.read.schema("version int, vslot int, shard int").parquet(f"{folder}/version-{version or known[-1]}")


def store_map(slot_map: DataFrame, folder: str, version: int) -> DataFrame:
    """Keeps the map as a version of the folder, which must not have it yet, and reads it back."""
    spark = slot_map.sparkSession
    known = versions(spark, folder)
    if known and version <= known[-1]:
        raise ValueError(f"version {version} is there already")
    # what a lost driver left incomplete is written over; complete versions never change
    slot_map.select(F.lit(version).alias("version"), "vslot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version-{version}")
    return load_map(spark, folder, version)


def balanced_map(loads: DataFrame, shards: int, folder: str, slots: int = SLOTS) -> DataFrame:
    """The folder's newest map after rebalancing it for the measured ``loads``.

    An empty folder gets version 1, slots dealt round robin.  The rebalanced map
    is stored as the next version if a slot moves.
    """
    spark = loads.sparkSession
    known = versions(spark, folder)
    now = load_map(spark, folder) if known else store_map(first_map(spark, shards, slots), folder, 1)
    edited = Stored(rebalance(now, loads, shards).coalesce(1), "slot-map")
    moved = not edited.df.select("vslot", "shard").exceptAll(now.select("vslot", "shard")).isEmpty()
    out = store_map(edited.df, folder, (known[-1] if known else 1) + 1) if moved else now
    edited.drop()
    return out


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Puts every row into one of ``shards`` by law ``bytes``.

    The map comes from ``folder``, where the rebalanced one is kept for the next
    run; without a folder it starts anew and goes with the application.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot (the
    row's place in its shard, gapless from 0), grown_shard (null under this
    law), vslot and map_version.

    Null text counts as empty, a very long one makes its slot heavy; a null doc_id
    hashes by content; equal rows are kept apart and take neighbouring places; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    records = sized(docs, slots)
    loads = Stored(slot_bytes(records).coalesce(1), "slot-bytes").df
    newest = balanced_map(loads, shards, folder or scratch(spark, "slot-maps"), slots)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        newest.join(F.broadcast(loads), "vslot", "left").fillna(0, ["slot_rows"])
        .withColumn("place", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)))
        .select("vslot", "shard", "place", F.col("version").alias("map_version"))
    )
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(placed), "vslot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("place") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
        )
    )
