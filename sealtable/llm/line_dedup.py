"""Corpus-wide line deduplication that moves hashes and positions, never lines.

A line's key is hashed to 128 bits. Each document sends one record per line of
a key, written once. Records are dealt by ranges of hash and a salt of the
document, and sorted by hash, salt, document and position. Streaming through
them gives the first occurrence of each hash and salt in the keeping order,
and the number of its documents. These, one row for each hash and salt, are
put together to a verdict for the hash, which goes back to the records by hash
and salt, so that no line is a hot key. Each document that loses lines gets its
bitmap of kept lines, compressed to runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, checkpointed, staged

#: Parts among which the documents of one line key are dealt, so that no line is a hot key.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_records(docs: DataFrame, min_chars: int, salts: int) -> DataFrame:
    """(doc, digest, n_lines, h1, h2, salt, spot): the lines of ``docs`` (doc, digest, text) whose key is long enough."""
    lines = docs.withColumn("lines", staged(_lines(F.col("text"))))
    lines = lines.select("doc", "digest", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("spot", "line"))
    # A line shorter than the bound can't have a key that reaches it, so most junk ends here.
    keyed = lines.filter(F.length("line") >= min_chars).withColumn("line", F.trim(F.col("line"), F.lit(SPACE_CHARS)))
    keyed = keyed.filter(F.length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line")))
    return keyed.select(
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(7), "line").alias("h2"),
        F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"),
        "doc",
        "digest",
        "n_lines",
        "spot",
    )


def kept_runs(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
) -> DataFrame:
    """The compressed bitmaps: (doc, digest, n_lines, n_dropped, runs) for each document that drops lines.

    ``runs`` lists (start, length) of the kept lines, ascending; documents
    without a row keep all. Texts are split at line feeds; a key is the line without
    white space at both ends, A-Z lower-cased. A key of at least ``min_chars``
    characters found in at least ``min_docs`` documents (distinct ids; a null
    id is one document) keeps its lines only in the document of the largest id;
    all its lines there stay. A null text is one empty line. Rows that repeat an
    id are told apart by ``digest``, a hash of the text; equal rows share a
    bitmap. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("digest"), F.col(f"`{text_col}`").alias("text"))
    # Cut once: ranges are drawn from a sample, so the texts would else be split for that and then again, and for the join.
    records = checkpointed(_line_records(rows, min_chars, salts))
    # Secondary sort: within a hash and salt, documents from the largest id down, then positions.
    # The window needs no exchange of its own: a range of (h1, h2, salt) holds its groups whole.
    ranged = records.repartitionByRange("h1", "h2", "salt")
    group = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc").desc_nulls_last(), "spot")
    previous = F.lag(F.struct("doc")).over(group)
    streamed = ranged.select("h1", "h2", "salt", "doc", previous.isNull().alias("first"), (previous.isNull() | ~previous["doc"].eqNullSafe(F.col("doc"))).alias("fresh"))
    firsts = (
        streamed.filter("fresh")
        .groupBy("h1", "h2", "salt")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("first"), F.col("doc"))).alias("first_doc"))
    )
    # At most one row for each salt of a hash from here on.
    verdicts = (
        firsts.groupBy("h1", "h2")
        .agg(F.sum("n").alias("n_docs"), F.max("first_doc").alias("keeper"), F.collect_list("salt").alias("salts"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper", F.explode("salts").alias("salt"))
    )
    dropped = records.join(verdicts, ["h1", "h2", "salt"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    spots = dropped.groupBy("doc", "digest", "n_lines").agg(F.array_sort(F.collect_set("spot")).alias("spots"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("spots"))
    kept = spots.select("doc", "digest", F.col("n_lines").cast("long").alias("n_lines"), F.size("spots").cast("long").alias("n_dropped"), staged(kept).alias("kept"))
    return kept.select("doc", "digest", "n_lines", "n_dropped", _runs(F.col("kept")).alias("runs"))


def _runs(spots: Column) -> Column:
    """Ascending distinct positions as runs (start, length)."""
    starts = F.filter(spots, lambda p, i: (i == 0) | (F.get(spots, i - 1) != p - 1))
    ends = F.filter(spots, lambda p, i: (i == F.size(spots) - 1) | (F.get(spots, i + 1) != p + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` without its dropped lines, and ``n_lines`` (before) and ``n_dropped``.

    The bitmaps are the small side of the join. Input columns of these names are
    replaced. A null text becomes an empty one; every row of ``docs`` stays.
    """
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest"), F.col("n_dropped").alias("__n"), F.col("runs").alias("__runs"))
    joined = docs.join(
        marks.hint("shuffle_hash"),
        docs[f"`{id_col}`"].eqNullSafe(marks["__doc"]) & (F.xxhash64(docs[f"`{text_col}`"]) == marks["__digest"]),
        "left",
    )
    joined = joined.withColumn("__lines", staged(_lines(F.col(f"`{text_col}`"))))
    lines, runs = F.col("__lines"), F.col("__runs")
    # The bitmap unpacked: the length of the lines' array at most, and read by index. (A slice would copy all lines.)
    kept = F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    text = F.when(runs.isNull(), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )
    counts = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.col("__n"), F.lit(0)).cast("long")}
    return joined.withColumns({text_col: text} | counts).drop("__doc", "__digest", "__n", "__runs", "__lines")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without lines repeated across documents; see :func:`kept_runs` and :func:`keep_lines`."""
    return keep_lines(docs, kept_runs(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
