"""Quality by compression: which of two dictionaries makes a text smaller?

One zstandard dictionary is built from good and one from bad labelled texts. A
text is compressed with each, and without any. The differences between these
three sizes, normalised by their sums and by the text's length, become a
probability by a logistic calibration. It is fitted on sizes that are fair: the
sample is cut into folds, and each is compressed with dictionaries built from
the others. Fitting takes a bounded sample; scoring is one pass without a
shuffle, with a broadcast of two dictionaries of a fixed size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_rows

#: Labelled rows a model is fitted on, and the largest text among them, in bytes.
MAX_ROWS, MAX_BYTES = 6000, 1 << 16
#: Bytes of a dictionary, compression level, bytes of a training piece.
DICT_BYTES, LEVEL, PIECE = 112_640, 3, 4096
#: Parts of the sample that are left out in turn for the calibration.
FOLDS = 8
#: A text is good if its score reaches this.
THRESHOLD = 0.3


def _dictionary(texts: Sequence[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train on, the texts themselves."""
    pieces = [text[at : at + PIECE] for text in texts for at in range(0, len(text), PIECE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICT_BYTES:]


class _Sizes:
    """Compressed sizes with either dictionary and without."""

    def __init__(self, good: bytes, bad: bytes):
        self._tools = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]
        for content in (good, bad):
            kind = zstandard.DICT_TYPE_AUTO if len(content) >= 8 else zstandard.DICT_TYPE_RAWCONTENT
            known = zstandard.ZstdCompressionDict(content, dict_type=kind)
            if len(content) >= 8:
                known.precompute_compress(level=LEVEL)
            self._tools.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
            )

    def differences(self, texts: Sequence[bytes]) -> np.ndarray:
        """Of each two of the sizes, their difference by their sum and by the text's length."""
        plain, good, bad = (np.fromiter((len(tool.compress(t)) for t in texts), float, len(texts)) for tool in self._tools)
        length = np.fromiter(map(len, texts), float, len(texts)) + 1.0
        pairs = ((bad, good), (plain, good), (plain, bad))
        return np.column_stack([(x - y) / by for x, y in pairs for by in (x + y, length)])


@dataclass(frozen=True)
class CompressionModel:
    """``prior`` alone (no weights) scores where the sample lacks a class."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        if not len(self.weights) or not texts:
            return np.full(len(texts), self.prior)
        raw = _Sizes(self.good, self.bad).differences(texts)
        return 1 / (1 + np.exp(-np.clip(_terms(raw, self.mean, self.scale) @ self.weights, -30, 30)))


def _terms(raw: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((raw - mean) / scale, -6, 6)
    return np.column_stack([np.ones(len(z)), z, z**2, z**3])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        f = x @ v
        return float(np.sum(np.logaddexp(0, f) - y * f) + 0.5 * np.sum(penalty * v * v))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit_compression(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> CompressionModel:
    """A model from at most ``max_rows`` labelled texts of at most ``max_bytes`` bytes, held-out rows excluded."""
    rows = labelled_rows(docs, labels, label, max_rows).filter(F.octet_length("text") <= max_bytes)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := [b.to_pandas() for b in batches if b.num_rows]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(pd.concat(parts)))], pa.binary())], names=["model"])

    # A bounded sample, so one task takes it all; the driver gets the model alone.
    model = rows.repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(bytes(model[0])) if model else _fitted(pd.DataFrame({"_id": [], "label": [], "text": []}))


def _fitted(rows: pd.DataFrame) -> CompressionModel:
    """A model from rows (_id, label, text), in whatever order they are."""
    rows = rows.sort_values(["_id", "label", "text"]).sample(frac=1, random_state=7)
    texts, y = [t.encode() for t in rows["text"]], (rows["label"].to_numpy() > 0).astype(float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    folds = min(FOLDS, int(min(y.sum(), (1 - y).sum())))
    if folds < 2:
        empty = np.zeros(0)
        return CompressionModel(b"", b"", empty, empty, empty, prior)
    # Each class is dealt evenly, so none lacks where a fold is left out.
    fold = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y == 0)) % folds

    def dictionaries(left_out: int) -> tuple[bytes, bytes]:
        good, bad = ([t for t, k, own in zip(texts, fold, y) if k != left_out and own == kind] for kind in (1, 0))
        return _dictionary(good), _dictionary(bad)

    raw = np.zeros((len(texts), 6))
    for k in range(folds):
        at = np.flatnonzero(fold == k)
        raw[at] = _Sizes(*dictionaries(k)).differences([texts[i] for i in at])
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-9
    weights = _logistic(_terms(raw, mean, scale), y)
    return CompressionModel(*dictionaries(-1), mean, scale, weights, prior)


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of being good; null texts count as empty, every row stays.

    An input column named ``out_col`` is replaced. Texts are compressed whole.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(known.value.score([(t or "").encode() for t in texts]))

    return docs.withColumn(out_col, score(F.col(f"`{text_col}`").cast("string")))


def keep_good(
    docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """The rows that score ``threshold`` or more, with the columns of ``docs``."""
    return score_quality(docs, model, text_col, "__score").filter(F.col("__score") >= threshold).drop("__score")
