"""SimHash near-duplicates, found by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at
most two bits (three, even), one half differs in at most one. So each half is
indexed once per bit with that bit wiped out: 64 keys a fingerprint, and two
that are near share a key. Keys are joined by equality and the whole
fingerprints compared in the join itself.

Equal fingerprints are one node from the start, so copies never meet as pairs.
A key that more than ``LIGHT`` distinct fingerprints share is not joined to
itself; its fingerprints are linked exactly by another route, whose groups
cannot grow: each is listed under every value within one bit of it. Two within
two bits of each other meet there, no group has more than 65 members, any two
members are near, and each is linked to the least member alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot, sorted_side
from .components import connected_components
from .near_copies import crowd_links, signatures, similar_links

#: Distinct fingerprints of one key that are compared pair by pair.
LIGHT = 64
#: Shingles whose bits are counted at once, which bounds memory for long texts.
_CHUNK = 1 << 16


def simhash64(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text, unsigned: bit i is set if set in over half the shingles' XXH64 (seed 42).

    A-Z are lower-cased; shingles are ``shingle`` words joined by a space,
    repeats included. A text of fewer words is one shingle; one of none gives 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        to = min(at + _CHUNK, n)
        runs = zip(*(words[at + i : to + i] for i in range(shingle)))
        hashes = np.fromiter((digest(join(run), 42) for run in runs), dtype="<u8", count=to - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, digest, fp) per row: id, a hash of the text that tells rows of one id apart, fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            values = np.fromiter((simhash64(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            columns = [batch.column(0), batch.column(1), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "digest", "fp"])

    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, digest bigint, fp bigint")


def near_links(fps: DataFrame, max_bits: int = 2, light: int = LIGHT) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` as all pairs within ``max_bits`` bits would."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two halves with one wildcard each are meant for at most two differing bits")
    # Each row becomes 64: so few bytes would else be put together into a few tasks beforehand. A key of
    # its own keeps the exchange: one by fp that follows a grouping by fp would be taken out again.
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    halves = fps.repartition(spread, F.xxhash64("fp", F.lit("spread"))).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    half = F.when(F.col("v") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    wiped = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, v % 32)")))
    index = halves.select(F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(wiped).alias("key"), "fp")
    shared_keys = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = checkpointed(index.join(sorted_side(shared_keys), "key"))

    few = shared.filter(F.col("n") <= light)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    pairs = left.join(sorted_side(right), (left["key"] == right["key"]) & near).select("a", "b")

    crowd = shared.filter(F.col("n") > light).select("fp").distinct()
    return pairs.union(_ball_links(crowd, max_bits)).distinct()


def _ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """The same edges by groups of bounded size, at 64 or 65 rows a fingerprint."""
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if max_bits == 1:
        # With bit i wiped out, two that differ there alone are equal.
        spots = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
        keyed = fps.select("fp", spots).withColumn("z", F.expr("fp & ~shiftleft(1L, i)"))
    else:
        # The value itself (i = 64) and each value one bit away.
        spots = F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")
        keyed = fps.select("fp", spots).selectExpr("fp", "0 as i", "if(i = 64, fp, fp ^ shiftleft(1L, i)) as z")
    heads = keyed.groupBy("i", "z").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(sorted_side(heads), ["i", "z"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")


def near_components(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    light: int = LIGHT,
    similarity: float | None = None,
) -> DataFrame:
    """(doc, digest, fp, root, component) per row: component is the least id reachable over links, itself included.

    Links join fingerprints at ``max_bits`` or fewer differing bits and, given a
    ``similarity``, texts whose sets of shingles are at least as similar. Null and
    empty texts have fingerprint 0 and are linked like any other. A null id is
    passed over when the least id is sought; a component of null ids alone has
    a null id; ``root`` tells such components apart. Equal rows share everything. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")))
    edges = near_links(nodes.select("fp"), max_bits, light)
    if similarity is not None:
        of_text = checkpointed(prints.select("digest", "fp").distinct())
        signed = signatures(docs, shingle, id_col, text_col)

        def between(links: DataFrame) -> DataFrame:
            ends = links.join(sorted_side(of_text.toDF("a", "fp_a")), "a").join(sorted_side(of_text.toDF("b", "fp_b")), "b")
            return ends.select("fp_a", "fp_b").filter("fp_a <> fp_b")

        edges = edges.union(between(similar_links(docs, prints, signed, similarity, shingle, id_col, text_col)))
        roots = checkpointed(connected_components(edges))
        sizes = of_text.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
        of_print = sizes.join(sorted_side(roots.toDF("fp", "root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n")
        # A fingerprint may be that of very many texts.
        rooted = join_hot(of_text, checkpointed(of_print), "fp").select("digest", "root")
        rest = between(crowd_links(docs, prints, signed, rooted, similarity, shingle, id_col, text_col))
        edges = roots.union(rest)
    roots = checkpointed(connected_components(edges))
    linked = checkpointed(nodes.join(sorted_side(roots), nodes["fp"] == roots["node"]).select("fp", "root", "least"))
    heads = linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    # A component may hold very many fingerprints, and a fingerprint very many documents.
    placed = join_hot(linked, heads, "root").select("fp", "root", "component")
    of_print = checkpointed(
        nodes.join(sorted_side(placed), "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component"), "n"
        )
    )
    return join_hot(prints, of_print, "fp").select("doc", "digest", "fp", "root", "component")


def keep_one(
    docs: DataFrame,
    shingle: int = 5,
    max_bits: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float | None = None,
) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the least id, then the least hash of the text.

    Rows equal in id and text are one document. Null ids come last.
    """
    found = near_components(docs, shingle, max_bits, id_col, text_col, similarity=similarity)
    first = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "digest")).alias("first")
    each = found.groupBy("root", "doc", "digest").agg(F.count(F.lit(1)).alias("n"))
    best = each.groupBy("root").agg(first, F.max("n").alias("n"))
    keep = checkpointed(
        best.select(F.col("first.doc").alias("__doc"), F.col("first.digest").alias("__digest"), (F.col("n") > 1).alias("__again"))
    )

    def rows(again: bool) -> DataFrame:
        side = keep.filter(F.col("__again") == again)
        same = docs[f"`{id_col}`"].eqNullSafe(side["__doc"]) & (F.xxhash64(docs[f"`{text_col}`"]) == side["__digest"])
        return docs.join(side.hint("shuffle_hash"), same, "left_semi")

    # Only where rows of a component repeat can the row to keep be there twice.
    repeated = rows(True).withColumn("__digest", F.xxhash64(f"`{text_col}`")).dropDuplicates([id_col, "__digest"])
    return rows(False).unionByName(repeated.drop("__digest"))
