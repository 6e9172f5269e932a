"""Pairs of texts whose sets of word shingles are similar, by MinHash bands and exact comparison.

A text's signature is the least of its shingles' hashes under ``BANDS * ROWS``
orders. Texts with an equal band are compared by their whole sets of shingles:
two of similarity s meet in some band with probability 1 - (1 - s^ROWS)^BANDS,
0.9998 at 0.8 and more above. In a band that many texts share each meets its
neighbours by the band after and the band before, as seeds do in ``substring``.
Where that leaves the texts of such a band in several components, all pairs of
texts of different components are compared (``crowd_links``), tile by tile, so
components are those of all pairs that share a band.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot, sorted_side, stored
from .substring import LIGHT, ORDER, SEED, meetings

BANDS, ROWS = 16, 4
#: Texts of a crowded band that are compared with as many others in one task.
TILE = 512
#: Shingles hashed under all orders at once, which bounds memory for long texts.
_CHUNK = 1 << 13
_ORDERS = np.random.RandomState(7).randint(0, 1 << 62, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; A-Z are lower-cased, a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter((zlib.crc32(w) | zlib.adler32(w) << 32 for w in words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(min(shingle, len(words))):
        mixed = (mixed ^ own[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(mixed ^ mixed >> np.uint64(32))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band of a text's signature, as signed longs."""
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, (shingles[at : at + _CHUNK, None] * _ORDERS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    return docs.select(F.xxhash64(f"`{text_col}`").alias("digest"), text, F.col(f"`{id_col}`").alias("doc")).filter("text is not null")


def signatures(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bands of each text as rows of ``SEED``: h is the band, text the hash of the text. Copies may be there again."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            found, owner = [np.zeros((0, BANDS), np.int64)], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest not in known and len(shingles := shingle_set(text.as_py(), shingle)):
                    known.add(digest)
                    found.append(bands(shingles)[None])
                    owner.append(digest)
            keys = np.concatenate(found)
            after, before = np.roll(keys, -1, axis=1), np.roll(keys, 1, axis=1)
            texts, spots = np.repeat(np.array(owner, np.int64), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(owner))
            columns = [keys.ravel(), after.ravel(), before.ravel(), texts, spots]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=ORDER)

    return stored(_rows(docs, id_col, text_col).select("digest", "text").mapInArrow(signed, SEED))


def _shingles(docs: DataFrame, prints: DataFrame, asked: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(digest, shingles) of the ``asked`` (digest) texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["digest", "shingles"])

    # Of the copies of a text one is compared; the id is part of the key, so that they don't all meet in one task.
    one = asked.join(sorted_side(prints.groupBy("digest").agg(F.min("doc").alias("doc"))), "digest").toDF("asked", "asked_doc")
    same = (F.col("digest") == F.col("asked")) & F.col("doc").eqNullSafe(F.col("asked_doc"))
    found = _rows(docs, id_col, text_col).join(one.hint("shuffle_hash"), same, "left_semi").select("digest", "text")
    return checkpointed(found.mapInArrow(sets, "digest bigint, shingles binary").dropDuplicates(["digest"]))


def similar_links(
    docs: DataFrame, prints: DataFrame, signed: DataFrame, similarity: float, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(a, b) of hashes of texts whose sets of shingles have at least this Jaccard similarity. Empty texts have no pair.

    ``prints`` has (doc, digest) for each row of ``docs``, digest being the hash of
    its text; ``signed`` their ``signatures``. Of a band that more than ``LIGHT``
    texts share only neighbours are compared; for the rest see ``crowd_links``.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    pairs = checkpointed(meetings(signed.repartitionByRange(*ORDER), False).select("a", "b").distinct())
    asked = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    shingles = _shingles(docs, prints, asked, shingle, id_col, text_col)
    left, right = shingles.toDF("a", "left"), shingles.toDF("b", "right")
    met = pairs.join(sorted_side(left), "a").join(sorted_side(right), "b").select("a", "b", "left", "right")
    return checkpointed(met.mapInArrow(compared, "a bigint, b bigint"))


def tile_links(roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of places of similar sets that join all there are between different ``roots`` into the components of all such pairs."""
    sizes = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    group, mark, found = np.unique(roots, return_inverse=True)[1], np.zeros(len(names), bool), []
    for x in range(len(sets) - 1):
        if (group[x + 1 :] == group[x]).all():
            continue
        own = ids[starts[x] : starts[x] + sizes[x]]
        mark[own] = True
        common = np.add.reduceat(mark[ids[starts[x + 1] :]], starts[x + 1 :] - starts[x + 1], dtype=np.int64)
        mark[own] = False
        near = x + 1 + np.flatnonzero(common >= similarity * (sizes[x] + sizes[x + 1 :] - common))
        for y in near.tolist():
            if group[y] != group[x]:
                found.append((x, y))
                group[group == group[y]] = group[x]
    return found


def crowd_links(
    docs: DataFrame,
    prints: DataFrame,
    signed: DataFrame,
    roots: DataFrame,
    similarity: float,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(a, b) of similar texts that share a band of more than ``LIGHT`` texts and have different ``roots`` (digest, root).

    Together with the links that led to ``roots`` these give the components of all
    similar texts that share a band. The texts of a band are dealt into tiles and
    every two tiles meet in a task, so a band of n texts costs n * n / ``TILE``
    rows, and nothing where it is of one component.
    """
    crowded = signed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LIGHT)
    crowd = checkpointed(join_hot(signed.select("h", "text"), checkpointed(crowded), "h").select("h", F.col("text").alias("digest")).distinct())
    rooted = checkpointed(crowd.join(sorted_side(roots), "digest"))
    mixed = rooted.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("mixed"))
    mixed = mixed.filter("mixed").select("h", F.col("n"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    rest = checkpointed(join_hot(rooted, checkpointed(mixed), "h"))
    shingles = _shingles(docs, prints, rest.select("digest").distinct(), shingle, id_col, text_col)
    own = F.pmod(F.xxhash64("digest", F.lit("tile")), F.col("tiles")).cast("int").alias("own")
    dealt = rest.select("h", "digest", "root", own, "tiles").select("*", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    dealt = dealt.select("h", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "digest", "root")

    def compared(tile: pa.Table) -> pa.Table:
        # In one order, whatever order they came in.
        tile = tile.sort_by("digest")
        digests = tile["digest"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in tile["shingles"]]
        found = np.array(tile_links(tile["root"].to_numpy(), sets, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": digests[found[:, 0]], "b": digests[found[:, 1]]})

    return checkpointed(dealt.join(sorted_side(shingles), "digest").groupBy("h", "low", "high").applyInArrow(compared, "a bigint, b bigint"))
