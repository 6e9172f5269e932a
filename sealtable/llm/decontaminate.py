"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of ``window`` consecutive words (a shorter item
is one window). A window's tokens are its shingles of ``SHINGLE`` words (single
words where it has fewer). To contain a window a document must contain all its
tokens, so for exact containment the necessary prefix of its tokens, ordered by
rarity, is the rarest one. Rarity is counted over all documents in one pass,
whatever the benchmark's size; a window with a token no document has is done.

In a second pass documents send an occurrence of each prefix token, with the
few words around it, to an equality join with the windows on the token. The
token's place fixes where the window would start: it must lie in the document
with room for its length, and the words there must equal the window's.

Both passes are told which tokens matter by a Bloom filter of a fixed number of
bits. A benchmark too large for it lets more tokens through, which the joins
drop; nothing that grows with either table is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, checkpointed, stored

#: Consecutive item words that must recur; words of a token.
WINDOW, SHINGLE = 8, 3
#: Bits of a Bloom filter, as a power of two: 1 MiB.
FILTER_BITS = 23
#: Tokens counted in a task before the counts are sent on, and parts into which a hot token's occurrences are dealt.
_HELD, SALTS = 1 << 20, 32
#: Bytes that belong to words stay (A-Z in lower case), every other byte parts them.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    """ASCII letters and digits and everything beyond ASCII, in runs; A-Z lower-cased. None has no words."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def item_windows(text: str | None, window: int = WINDOW) -> Iterator[list[bytes]]:
    found = item_words(text)
    if found and len(found) < window:
        yield found
    for at in range(len(found) - window + 1):
        yield found[at : at + window]


def tokens(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash, as a signed long, of each run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    own = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mixed = np.full(n, size, np.uint64)
    for j in range(size):
        mixed = (mixed ^ own[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ mixed >> np.uint64(32)).view(np.int64)


class TokenFilter:
    """A Bloom filter of tokens: no token is missed, some may pass that are not in it."""

    def __init__(self, found: DataFrame):
        """``found`` has a column ``token``. At most 2**FILTER_BITS / 64 rows come to the driver."""
        bits = FILTER_BITS
        self.mask = (1 << bits) - 1
        spots = F.explode(F.array(F.col("token"), F.shiftrightunsigned("token", 32))).alias("spot")
        marks = found.select(spots).select(F.col("spot").bitwiseAND(F.lit(self.mask)).alias("spot"))
        slots = marks.groupBy(F.shiftright("spot", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("marks"))
        self.slots = np.zeros(1 << max(0, bits - 6), np.int64)
        for r in slots.collect():
            self.slots[r["slot"]] = r["marks"]

    def places(self, of: np.ndarray) -> np.ndarray:
        """The places of ``of`` whose token may be in the filter, ascending."""
        found = np.arange(len(of))
        for shift in (0, 32):
            spot = of[found].view(np.uint64) >> np.uint64(shift) & np.uint64(self.mask)
            found = found[self.slots[(spot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (spot & np.uint64(63)) & np.uint64(1) == 1]
        return found


_WINDOWS = "item string, words string, length int, tokens array<bigint>"


def _windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(words, length, tokens, items) of each distinct window; items are structs, so that a null id is one too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                found = {b" ".join(run): run for run in item_windows(text.as_py(), window)}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item.as_py()] * len(found), pa.string()),
                        pa.array([w.decode() for w in found], pa.string()),
                        pa.array([len(run) for run in found.values()], pa.int32()),
                        pa.array([tokens(run, _size(len(run))).tolist() for run in found.values()], pa.list_(pa.int64())),
                    ],
                    names=["item", "words", "length", "tokens"],
                )

    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = items.mapInArrow(cut, _WINDOWS)
    return checkpointed(
        found.groupBy("words").agg(
            F.max("length").alias("length"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set(F.struct("item"))).alias("items")
        )
    )


def _size(length: int) -> int:
    return SHINGLE if length >= SHINGLE else 1


def _document_frequency(texts: DataFrame, known: TokenFilter, sizes: list[int]) -> DataFrame:
    """(token, n): the documents (rows of ``text``) that hold each token which passes the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], names=["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                words = item_words(text.as_py())
                for size in sizes:
                    of = tokens(words, size)
                    if len(kept := shared.value.places(of)):
                        found.append(np.unique(of[kept]))
                        held += len(found[-1])
            if held > _HELD:
                yield counted(found)
                found, held = [], 0
        yield counted(found)

    return texts.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _prefixes(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """(token, n, offset, length, words, items): each window that can occur, by its rarest token and that one's place in it."""
    listed = windows.select("words", F.size("tokens").alias("all"), F.posexplode("tokens").alias("offset", "token"))
    rarest = F.min(F.struct("n", "token", "offset")).alias("rarest")
    known = listed.join(frequency, "token").groupBy("words", "all").agg(F.count(F.lit(1)).alias("present"), rarest)
    # A token that no document holds proves that the window does not occur.
    possible = known.filter(F.col("present") == F.col("all")).select("words", "rarest.*")
    return checkpointed(possible.join(windows.select("words", "length", "items"), "words"))


def _occurrences(rows: DataFrame, known: TokenFilter, sizes: list[int], window: int) -> DataFrame:
    """(doc, digest, n_words, spots) per row of (doc, digest, text).

    ``spots`` are the tokens that pass the filter: (token, at, lead, around),
    where ``around`` are the words a window that holds the token could have, the
    token after ``lead`` of them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)
    spot = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("around", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spots = [], []
            for text in batch.column(2):
                words, found = item_words(text.as_py()), []
                for size in sizes:
                    of = tokens(words, size)
                    for at in shared.value.places(of).tolist():
                        lead = min(at, window - size)
                        around = b" ".join(words[at - lead : at + window]).decode()
                        found.append({"token": int(of[at]), "at": at, "lead": lead, "around": around})
                n_words.append(len(words))
                spots.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spots, spot)], names=["doc", "digest", "n_words", "spots"]
            )

    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, digest bigint, n_words bigint, spots array<struct<token:bigint,at:int,lead:int,around:string>>"
    # A batch of few documents bounds what its occurrences can take, also where a benchmark fills the filter.
    return rows.mapInArrow(find, schema)


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (doc, digest, n_words, spots), and (doc, digest, start, length, items) per window found."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    windows = _windows(benchmark, window, item_col, item_text_col)
    sizes = sorted({_size(r["length"]) for r in windows.select("length").distinct().collect()})
    vocabulary = windows.select(F.explode("tokens").alias("token"))
    frequency = _document_frequency(rows.select("text"), TokenFilter(vocabulary), sizes)
    prefixes = _prefixes(windows, frequency)
    found = checkpointed(_occurrences(rows, TokenFilter(prefixes), sizes, window))

    # A token with over 1 / HOT_KEYS of all occurrences would be one task's lot: there are fewer than HOT_KEYS of
    # these, and theirs are dealt by a salt, which their windows get all values of.
    counts = prefixes.select("token", "n").distinct()
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") * HOT_KEYS > total).select("token", F.lit(SALTS).alias("salts")))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    windowed = prefixes.drop("n").join(hot, "token", "left").select("token", "offset", "length", "words", "items", salts)
    spots = found.select("doc", "digest", "n_words", F.explode("spots").alias("spot")).select("doc", "digest", "n_words", "spot.*")
    spots = spots.join(hot, "token", "left").withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.coalesce("salts", F.lit(1))).cast("int"))

    start = (F.col("at") - F.col("offset")).alias("start")
    fits = (F.col("offset") <= F.col("lead")) & (F.col("at") - F.col("offset") + F.col("length") <= F.col("n_words"))
    there = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("length")), " ")
    met = spots.join(windowed, ["token", "salt"]).filter(fits).filter(there == F.col("words"))
    return found, met.select("doc", "digest", start, "length", "items")


_RUNS = "array<struct<start:int,length:int>>"


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc, digest, n_words, runs, items) per row of ``docs``.

    ``runs`` are the hit words as disjoint ascending (start, length), ``items``
    the ids, as strings, of the items with a window in the text, sorted. Null texts have
    no words. Items without words never match; rows of one item id are one item;
    rows without an id are one item too, which stands in ``items`` as a null. An
    empty benchmark finds nothing, an empty corpus gives no rows. ``digest``, a
    hash of the text, tells rows of one id apart.
    """
    rows, hits = _hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    kind = rows.schema["doc"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for spots in batch.column(2):
                start, length = (spots.values.field(k).to_numpy() for k in range(2))
                reach = np.maximum.accumulate(start + length)
                first = np.r_[True, start[1:] > reach[:-1]]
                begin, end = start[first], reach[np.r_[first[1:], True]]
                runs.append([{"start": s, "length": e - s} for s, e in zip(begin.tolist(), end.tolist())])
            runs = pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), runs, batch.column(3)], names=["of_doc", "of_digest", "runs", "items"])

    spots = F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spots")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    texts = hits.groupBy("doc", "digest").agg(spots, F.transform(items, lambda i: i["item"]).alias("items"))
    merged = texts.mapInArrow(merge, f"of_doc {kind}, of_digest bigint, runs {_RUNS}, items array<string>")
    same = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("digest") == F.col("of_digest"))
    return rows.join(merged, same, "left").select(
        "doc",
        "digest",
        "n_words",
        F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_items: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with passages of fewer than ``min_items`` items, columns unchanged; see :func:`find_items`."""
    _, hits = _hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    held = hits.select("doc", "digest", F.explode("items").alias("item")).distinct().groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("n"))
    # Written, so that its size is known: it is sent to all tasks only if it is small.
    bad = stored(held.filter(F.col("n") >= min_items).select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest")))
    same = docs[f"`{id_col}`"].eqNullSafe(bad["__doc"]) & (F.xxhash64(docs[f"`{text_col}`"]) == bad["__digest"])
    return docs.join(bad, same, "left_anti")


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, digest, n_words, n_hit, n_items, items, contaminated) per row; see :func:`find_items`."""
    found = find_items(docs, benchmark, window, id_col, text_col)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["length"])
    return found.select(
        "doc",
        "digest",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.size("items") >= min_items).alias("contaminated"),
    )
