"""From raw documents to sharded training text, in five stages.

Each stage takes the documents its predecessor kept, written as Parquet and
read again, and its decisions take effect: rejected, duplicate and contaminated
documents are gone, mixed ones may be there more than once. All stages but the
last return the columns of ``documents``; the last adds the shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sealtable.llm.common import read_table, stored
from sealtable.llm.decontaminate import drop_contaminated
from sealtable.llm.mixing import mix_documents
from sealtable.llm.quality_compression import fit_compression, keep_good
from sealtable.llm.sharding import assign_shards
from sealtable.llm.simhash import keep_one

#: Shares of the tokens that each language should have after mixing.
LANGUAGE_WEIGHTS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}
#: No document is dropped to meet the shares, and none is there more than this often.
MOST_COPIES = 3.0
#: Items of the benchmark with a passage in a document that make it unfit for training.
MIN_ITEMS = 1
N_SHARDS = 16
#: Similarity of two documents from which on one of them goes.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return keep_good(docs, fit_compression(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays.

    Linked are documents whose five-word shingles have a Jaccard similarity of
    ``SIMILARITY`` or more, and those with fingerprints at two or fewer bits.
    """
    return keep_one(docs, shingle=5, max_bits=2, similarity=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), min_items=MIN_ITEMS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce languages are repeated until the languages' tokens are near the weights.

    The labelled table is the documents' own language column; posteriors, not
    labels, set the rates, so unlabelled documents take part.
    """
    labelled = docs.select("doc_id", "lang")
    return mix_documents(docs, labelled, LANGUAGE_WEIGHTS, least=1.0, most=MOST_COPIES, keep_all=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard, by rendezvous hashing of its id."""
    return assign_shards(docs, N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Compression and classifiers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs)
    return docs
