"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed. Besides a weight per term the
machine learns a short vector per term, and the product of two vectors is the
weight of the pair: an insult beside a mention of a group can weigh more than
both alone. Terms of the machine are those that the label goes with, be it
alone or only beside another term: a word that is as frequent in clean texts
counts if some pair it is in does not. Fitting takes a bounded sample of
labelled rows, reduced to hashed terms on the executors; scoring is one pass
without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_rows

#: Labelled rows a model is fitted on, and the largest text among them, in bytes.
MAX_ROWS, MAX_BYTES = 12_000, 1 << 16
#: Buckets of hashed terms, as a power of two; length of a term's vector.
HASH_BITS, RANK = 20, 6
#: Bytes of the word beginnings that are terms too: inflected forms share them.
PREFIXES = (4, 6)
#: Labelled documents a term must be in, and the least standard score of its own association with the label.
MIN_DOCS, MIN_Z = 5, 4.0
#: How many terms, the most frequent, are tried in pairs, and the chance that any pair is kept that means nothing.
PAIRED, MISTAKE = 2048, 0.01
#: Least steps of a fit.
STEPS = 600
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def hashed_terms(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's words and word beginnings, ascending."""
    words = set((text or "").lower().encode().translate(_LETTERS).split())
    mask, crc = (1 << HASH_BITS) - 1, zlib.crc32
    found = {crc(w) & mask for w in words}
    for n in PREFIXES:
        found |= {crc(w, n) & mask for w in {w[:n] for w in words if len(w) > n}}
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass(frozen=True)
class FactorizationMachine:
    """``terms`` are the buckets in use, ascending; ``linear`` and ``vectors`` belong to them."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    vectors: np.ndarray

    def margin(self, found: np.ndarray) -> float:
        """The log-odds of a text with these buckets."""
        if not len(self.terms) or not len(found):
            return self.bias
        at = np.searchsorted(self.terms, found)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == found)]
        v = self.vectors[at]
        return self.bias + float(self.linear[at].sum() + 0.5 * (np.square(v.sum(axis=0)) - np.square(v).sum(axis=0)).sum())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(hashed_terms(text)), -30, 30))))


def _alone(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets associated with the label by themselves."""
    n, n1 = len(y), float(y.sum())
    hits = np.bincount(np.concatenate([r for r, label in zip(rows, y) if label] or [[]]).astype(int), minlength=1 << HASH_BITS)
    seen = np.bincount(np.concatenate(rows).astype(int), minlength=1 << HASH_BITS)
    share = seen / n
    z = np.abs(hits - n1 * share) / np.sqrt(n1 * (n - n1) / n * share * (1 - share) + 1e-9)
    return np.flatnonzero((seen >= MIN_DOCS) & (z >= MIN_Z))


def _paired(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets of pairs whose log-odds differ from the sum of their terms' own, among the ``PAIRED`` most frequent."""
    seen = np.bincount(np.concatenate(rows).astype(int), minlength=1 << HASH_BITS)
    terms = np.argsort(-seen, kind="stable")[:PAIRED]
    terms = terms[seen[terms] >= MIN_DOCS]
    place = np.full(1 << HASH_BITS, -1)
    place[terms] = np.arange(len(terms))
    # Rows, and rows of label 1, that hold both terms.
    both, both1 = (np.zeros((len(terms), len(terms)), np.float32) for _ in range(2))
    for start in range(0, len(rows), 1024):
        held = np.zeros((len(rows[start : start + 1024]), len(terms)), np.float32)
        for i, row in enumerate(rows[start : start + 1024]):
            at = place[row]
            held[i, at[at >= 0]] = 1
        both += held.T @ held
        held = held[y[start : start + 1024] > 0]
        both1 += held.T @ held
    n, n1 = np.float32(len(y)), np.float32(y.sum())
    one, one1 = np.diag(both)[:, None], np.diag(both1)[:, None]
    # With both, with either alone and with neither: how the log-odds depart from a sum.
    cells = [(both, both1, 1), (one - both, one1 - both1, -1), (one.T - both, one1.T - both1, -1)]
    cells.append((n - one - one.T + both, n1 - one1 - one1.T + both1, 1))
    departure, variance, least = np.zeros_like(both), np.zeros_like(both), np.full_like(both, np.inf)
    for of, of1, sign in cells:
        departure += sign * np.log((of1 + 0.5) / (of - of1 + 0.5))
        variance += 1 / (of1 + 0.5) + 1 / (of - of1 + 0.5)
        least = np.minimum(least, of)
    # The more pairs are tried, the surer one must be.
    score = NormalDist().inv_cdf(1 - MISTAKE / max(1, len(terms) * (len(terms) - 1)))
    found = (np.abs(departure) >= score * np.sqrt(variance)) & (least >= MIN_DOCS)
    np.fill_diagonal(found, False)
    return terms[found.any(axis=1)]


def _train(rows: list[np.ndarray], y: np.ndarray, epochs: int = 20, batch: int = 128, rate: float = 0.1, ridge: float = 3e-4) -> FactorizationMachine:
    n, n1 = len(y), float(y.sum())
    n0 = n - n1
    bias = float(np.log((n1 + 1) / (n0 + 1)))
    nothing = FactorizationMachine(np.zeros(0, np.int32), bias, np.zeros(0), np.zeros((0, RANK)))
    if not n1 or not n0:
        return nothing
    terms = np.union1d(_alone(rows, y), _paired(rows, y)).astype(np.int32)
    if not len(terms):
        return nothing
    place = np.full(1 << HASH_BITS, -1)
    place[terms] = np.arange(len(terms))
    rows = [(at := place[r])[at >= 0] for r in rows]

    random = np.random.RandomState(11)
    linear, vectors = np.zeros(len(terms)), random.normal(0, 0.02, (len(terms), RANK))
    g_bias, g_linear, g_vectors = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), RANK), 1e-6)
    order = np.arange(n)
    # A small sample is gone through more often: what a pair does is learnt after what its terms do.
    for _ in range(max(epochs, STEPS * batch // n)):
        random.shuffle(order)
        for start in range(0, n, batch):
            ids = order[start : start + batch]
            term = np.concatenate([rows[i] for i in ids])
            doc = np.repeat(np.arange(len(ids)), [len(rows[i]) for i in ids])
            sums = np.stack([np.bincount(doc, vectors[term, k], len(ids)) for k in range(RANK)], axis=1)
            squares = np.bincount(doc, np.square(vectors[term]).sum(axis=1), len(ids))
            margin = bias + np.bincount(doc, linear[term], len(ids)) + 0.5 * (np.square(sums).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[ids]) / len(ids)
            used = np.unique(term)
            step = np.bincount(term, error[doc], len(terms))[used] + ridge * linear[used]
            pull = np.stack([np.bincount(term, error[doc] * (sums[doc, k] - vectors[term, k]), len(terms)) for k in range(RANK)], axis=1)
            pull = pull[used] + ridge * vectors[used]
            # AdaGrad: each parameter's rate falls with its own squared gradients.
            g_linear[used] += step * step
            linear[used] -= rate * step / np.sqrt(g_linear[used])
            g_vectors[used] += pull * pull
            vectors[used] -= 0.5 * rate * pull / np.sqrt(g_vectors[used])
            total = float(error.sum())
            g_bias += total * total
            bias -= rate * total / np.sqrt(g_bias)
    return FactorizationMachine(terms, float(bias), linear, vectors)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> FactorizationMachine:
    """A machine from at most ``max_rows`` labelled texts of at most ``max_bytes`` bytes, held-out rows excluded.

    Where the sample lacks a class, its rate alone is what every text scores.
    """
    rows = labelled_rows(docs, labels, label, max_rows).filter(F.octet_length("text") <= max_bytes)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([hashed_terms(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), terms], names=["id", "label", "terms"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(reduce, f"id {kind}, label double, terms binary").toPandas().sort_values(["id", "label", "terms"])
    return _train([np.frombuffer(t, np.int32) for t in found["terms"]], (found["label"].to_numpy() > 0).astype(float))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic; null texts count as empty, every row stays.

    An input column named ``out_col`` is replaced. Whole texts are read.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = known.value
        for texts in series:
            yield pd.Series([machine.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out_col, score(F.col(f"`{text_col}`").cast("string")))
