"""Shared pieces: reading tables, cutting lineage, word expressions, label splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: The same characters, as a string for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset, read by Spark, so any path Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local master, whose one machine runs all tasks, gets
    a temporary folder; a cluster, which could not share one, gets an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sealtable-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the cluster's shared checkpoint folder and read it from there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of wide rows: a Parquet table in the shared folder, deleted when the driver ends."""
    spark = df.sparkSession
    folder = f"{_shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    return spark.read.parquet(folder)


#: Keys that a join may treat as hot, and so the rows that it broadcasts, at most.
HOT_KEYS = 10_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` joined (inner) with ``side``, which has each ``key`` once and, in ``count``, its number of ``rows``.

    A key with over 1 / ``HOT_KEYS`` of all rows would be one task's lot. Of
    those there are fewer than ``HOT_KEYS``, so their part of ``side`` is
    broadcast; the rest meets by a shuffle, however small Spark takes it to be. Both sides are read twice, so they
    should be cheap to read. ``count`` is not part of the result.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_KEYS > total
    # Fewer than HOT_KEYS rows, by the sum of their shares.
    few, rest = F.broadcast(side.filter(hot).drop(count)), side.filter(~hot).drop(count)
    cold = rows.join(F.broadcast(side.filter(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(sorted_side(rest), key))


def sorted_side(side: DataFrame) -> DataFrame:
    """``side`` of a join that Spark must not broadcast.

    It sizes a table by its plan: one after an explode, or of long binary values
    from Python, is put far too low and would be sent whole to the driver.
    """
    return side.hint("merge")


def staged(column: Column) -> Column:
    """``column``, computed once where it stands.

    The optimizer may copy a column's expression to wherever it is used: into a
    filter pushed below it, or into a lambda that reads an array by index, where
    it would be computed anew for each element. The condition here is always
    true, but keeps the expression from being moved.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the engine's fast path; the rest is mapped by character."""
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(parts, lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    max_rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """At most ``max_rows`` training rows ``(text, label)``, the same ones on every run.

    Held-out documents and rows without a label or text never take part. The
    rows with the smallest hash of their id are taken, so the sample is uniform
    and does not follow the order of the files. The label side is cut down to
    its bound before it meets the texts, so no text of an unused row is moved.
    A document with several labels counts once for each.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("label"))
        .filter(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id")))
        .distinct()
        .orderBy(F.xxhash64("_id", F.lit("sample")), "_id", "label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # Bounded by max_rows rows of two numbers, so this side may be sent to every executor.
    met = texts.join(F.broadcast(chosen), "_id").filter(F.col("text").isNotNull())
    # Map-side, equal rows of a task are one already, so a document held very often moves few texts.
    digest = F.struct(F.xxhash64("text").alias("h"), "text")
    return met.groupBy("_id", "label").agg(F.min(digest)["text"].alias("text")).select("_id", "text", "label")
