"""Sharding by weighted rendezvous hashing.

Every shard draws a number for a record's key; the smallest draw, divided by
the shard's weight, wins. The draw depends on the key and the shard's name
alone, so one more shard takes records only into itself, a removed shard hands
its own records round, and a raised weight only attracts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Parts of a shard within which records are ranked; bounds the rows of one ranking group.
SLOT_PARTS = 1024
#: Copies of a record that one row is spread out to at a time.
SPREAD = 1 << 12


def shard_of(keys: Sequence[Column], weights: Mapping[int, float]) -> Column:
    """The shard that wins the record, as an int column.

    ``weights`` maps shard numbers to positive weights; with equal weights the
    drawn integers themselves are compared. Null key parts are a value like any
    other, and records with equal keys share a shard. Equal draws go to the
    smaller shard number.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("at least one shard is needed, and every weight must be positive")
    even = len(set(weights.values())) == 1
    shards = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items())])

    def draw(of: Column) -> Column:
        drawn = F.shiftrightunsigned(F.xxhash64(*keys, of["shard"]), 11)
        if not even:
            # -ln(u) / w is exponential with rate w: the least one wins in proportion to the weights.
            drawn = -F.log((drawn.cast("double") + 0.5) / float(1 << 53)) / of["weight"]
        return F.struct(drawn.alias("draw"), of["shard"].alias("shard"))

    # One lambda for all shards: written out for each, they make a method that takes the compiler a gigabyte.
    return F.array_min(F.transform(shards, draw))["shard"]


def assign_shards(
    docs: DataFrame,
    n_shards: int,
    key_cols: Sequence[str] = ("doc_id",),
    weights: Mapping[int, float] | None = None,
    out_col: str = "shard",
) -> DataFrame:
    """``docs`` with its shard: a projection without a shuffle.

    An input column named like ``out_col`` is replaced. An empty table stays empty.
    """
    weights = weights or {s: 1.0 for s in range(n_shards)}
    return docs.withColumn(out_col, shard_of([F.col(f"`{c}`") for c in key_cols], weights))


def shard_manifest(
    docs: DataFrame,
    n_shards: int,
    key_col: str = "doc_id",
    text_col: str = "text",
    weights: Mapping[int, float] | None = None,
    slot_parts: int = SLOT_PARTS,
) -> DataFrame:
    """One row per record: key, size, text checksum, shard, slot in the shard, shard among one more.

    Slots run from 0 without gaps in each shard, ordered by a hash of the
    record and then by the record. Texts are reduced to size and checksum in the scan, so
    none is shuffled. Equal records are counted before they are moved and
    spread out again at the end, and a key's different records are dealt over
    the parts, so a key that holds many rows is no hot spot.
    A shard is ranked in ``slot_parts`` parts; the parts' sizes are at most
    shards x ``slot_parts`` rows and so may be broadcast.

    A null text has size 1 and checksum 0. Records with a null key share one
    shard. An empty table gives no rows. Other columns are not read.
    """
    now = weights or {s: 1.0 for s in range(n_shards)}
    grown = {**now, max(now) + 1: sum(now.values()) / len(now)}
    key = F.col("key")
    rows = docs.select(
        F.col(f"`{key_col}`").alias("key"),
        (F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(f"`{text_col}`").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    part = F.pmod(F.xxhash64(key, "size", "text_crc32", F.lit("slot")), F.lit(slot_parts)).cast("int")
    counted = checkpointed(
        rows.groupBy("key", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", shard_of([key], now))
        .withColumn("grown_shard", shard_of([key], grown))
        .withColumn("part", part)
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy("shard", "part")
        .agg(F.sum("copies").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = (
        Window.partitionBy("shard", "part")
        .orderBy("key", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        counted.withColumn("ahead", F.coalesce(F.sum("copies").over(within), F.lit(0)))
        .join(F.broadcast(offsets), ["shard", "part"])
        .withColumn("first", F.col("offset") + F.col("ahead"))
        .withColumn("last", F.col("first") + F.col("copies") - 1)
    )
    # A record's copies may be very many: they are spread out in blocks, so no row holds a list of them all.
    blocks = F.sequence(F.col("first"), F.col("last"), F.lit(SPREAD).cast("long"))
    placed = placed.withColumn("from", F.explode(blocks))
    placed = placed.withColumn("slot", F.explode(F.sequence(F.col("from"), F.least("last", F.col("from") + SPREAD - 1))))
    return placed.select(
        F.col("key").alias(key_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
