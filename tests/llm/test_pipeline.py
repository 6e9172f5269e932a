"""The SQL counterparts against DuckDB, and the pipeline stage by stage on odd rows."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from sealtable.llm.oracle import oracle_sql
from sealtable.llm.quality_compression import fit_compression
from sealtable.llm.queries import queries

from .test_duplicates import slow_simhash
from .test_rules_and_models import slow_items, slow_shard

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got, expected = queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(repr, f[columns].astype(object).values.tolist()))
    assert rows(got) == rows(expected)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, root int, n int, token string, __x int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A dataset with nulls, repeats, copies, edits, long texts and columns whose names the stages use."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(50)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = " ".join(word() for _ in range(120))
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 80").first()
    rows += [(None, None, None, None, None), (9001, None, "en", "a", None), (9002, "", "en", None, 0), (9003, " \n", None, "a", 2), (9004, base, "en", "a", 1)]
    rows += [(9005, base, "de", "b", 1), (9006, base.replace(" ", " edited ", 1), "en", "a", 1), rows[0], rows[0], (None, rows[1][1], "en", "a", 1)]
    rows += [(9007, f"{base} {passage['text']}", "en", "a", 1), (9008, " ".join(word() for _ in range(40_000)), "fr", "a", 1)]
    rows = [(*r, 0.5, "x", 1, 2, "t", 3) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def _plain(frame):
    return sorted(map(repr, frame.collect()))


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]

    model = fit_compression(docs, spark.read.parquet(f"{odd}/labels.parquet"))
    kept = corpus_pipeline.quality(spark, docs, odd)
    rows = docs.collect()
    scores = model.score([(r["text"] or "").encode() for r in rows])
    assert kept.columns == docs.columns and _plain(kept) == sorted(repr(r) for r, s in zip(rows, scores) if s >= 0.3)

    kept = corpus_pipeline.near_dedup(spark, docs, odd)
    shingles = [{tuple((r["text"] or "").lower().split()[i : i + 5]) for i in range(max(1, len((r["text"] or "").split()) - 4))} - {()} for r in rows]
    prints = [slow_simhash(r["text"], 5) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            alike = shingles[i] and shingles[j] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])
            if alike or bin(prints[i] ^ prints[j]).count("1") <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for r, g in zip(rows, group):
        first[g] = min(first.get(g, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(None if none else i) for none, i in first.values())

    kept = corpus_pipeline.decontaminate(spark, docs, odd)
    bench = [tuple(r) for r in spark.read.parquet(f"{odd}/benchmark.parquet").select("item_id", "text").collect()]
    assert kept.columns == docs.columns and _plain(kept) == sorted(repr(r) for r in rows if slow_items(r["text"], bench)[2] < 1)
    assert 9007 not in {r["doc_id"] for r in kept.collect()}

    mixed = corpus_pipeline.mix(spark, docs, odd)
    times = _plain(mixed)
    assert mixed.columns == docs.columns and set(times) == set(_plain(docs))
    assert all(_plain(docs).count(r) <= times.count(r) <= 3 * _plain(docs).count(r) for r in set(times))

    placed = corpus_pipeline.shard(spark, docs, odd)
    assert placed.columns == [*docs.columns, "shard"] and placed.count() == len(rows)
    assert all(r["shard"] == slow_shard(r["doc_id"], 16) for r in placed.collect() if r["doc_id"] is not None)


def test_run(spark, odd, tmp_path):
    """All stages in sequence, and over tables without rows."""
    out = corpus_pipeline.run(spark, odd)
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert out.columns == [*docs.columns, "shard"]
    assert set(_plain(out.drop("shard"))) <= set(_plain(docs)) and out.count() > 50
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
