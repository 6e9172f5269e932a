"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document a posterior over
the domains, so its tokens count for several domains in part. Document rates
(expected copies) are fitted by projected-gradient least squares: the expected
tokens of each domain should be its share of the total. All state of the
iteration is the list of steps taken, one small vector each: a document's rate
is an expression of its own posterior and those steps. An iteration is one
aggregation over (tokens, posterior) rows; rates are never stored, joined or
shuffled, and a lost executor costs nothing but its tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, staged, words

#: Labelled rows the classifier is fitted on; buckets of hashed words.
MAX_ROWS, FEATURES = 6000, 1 << 14
#: Most iterations, and the error of a domain's share at which they end.
MAX_STEPS, TOLERANCE = 40, 1e-4


@dataclass(frozen=True)
class DomainModel:
    """``model`` is None where the labelled table had fewer than two domains: then all posteriors are ``fixed``."""

    domains: tuple[str, ...]
    model: LogisticRegressionModel | None
    fixed: tuple[float, ...] = ()

    def posteriors(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``__tokens`` (words) and ``__p`` (posterior per domain, in the order of ``domains``)."""
        if self.model is None:
            shares = F.array(*[F.lit(share) for share in self.fixed])
            return docs.withColumns({"__tokens": F.size(words(F.col(f"`{text_col}`"))).cast("long"), "__p": shares})
        hashed = _hashed(docs.withColumn("__words", words(F.col(f"`{text_col}`"))))
        hashed = hashed.withColumn("__tokens", F.size("__words").cast("long")).drop("__words")
        scored = self.model.transform(hashed)
        return scored.withColumn("__p", staged(vector_to_array("__probability"))).drop("__terms", "__probability", "__raw", "__prediction")


def _hashed(docs: DataFrame) -> DataFrame:
    return HashingTF(inputCol="__words", outputCol="__terms", numFeatures=FEATURES, binary=True).transform(docs)


def fit_domains(
    docs: DataFrame,
    labelled: DataFrame,
    domains: Sequence[str],
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DomainModel:
    """A classifier of texts into ``domains`` from ``labelled`` (id, domain).

    At most ``max_rows`` labelled rows take part, those with the least hash of
    their id. Rows of other domains, or with nulls, don't take part.
    """
    chosen = (
        labelled.toDF("__id", "__domain")
        .filter(F.col("__id").isNotNull() & F.col("__domain").isin(*domains))
        .distinct()
        .orderBy(F.xxhash64("__id", F.lit("mix")), "__id", "__domain")
        .limit(max_rows)
    )
    label = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("__domain")).cast("double") - 1
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    # Bounded by max_rows rows of an id and a name, so this side may be sent to every executor.
    # Of an id's texts the one with the least hash counts, so the joined rows are bounded too.
    one = F.min(F.struct(F.xxhash64("__text"), "__text").alias("__text"))["__text"].alias("__text")
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__domain").agg(one)
    rows = rows.select(words(F.col("__text")).alias("__words"), label.alias("__label"))
    # A bounded sample: each partition more would send one gradient more in every iteration.
    rows = checkpointed(_hashed(rows).select("__terms", "__label")).coalesce(4)
    seen = [int(r[0]) for r in rows.select("__label").distinct().collect()]
    if len(seen) < 2:
        fixed = [float(k in seen) if seen else 1.0 / len(domains) for k in range(len(domains))]
        return DomainModel(tuple(domains), None, tuple(fixed))
    learner = LogisticRegression(
        featuresCol="__terms",
        labelCol="__label",
        probabilityCol="__probability",
        rawPredictionCol="__raw",
        predictionCol="__prediction",
        family="multinomial",
        regParam=0.01,
        maxIter=15,
    )
    # A last domain without rows must not shorten the posterior: one row of next to no weight stands for each.
    each = F.explode(F.array(*[F.lit(float(k)) for k in range(len(domains))]))
    blank = rows.limit(1).select("__terms", each.alias("__label"))
    rows = rows.withColumn("__weight", F.lit(1.0)).unionByName(blank.withColumn("__weight", F.lit(1e-6)))
    return DomainModel(tuple(domains), learner.setWeightCol("__weight").fit(rows))


@dataclass
class Mix:
    """The steps of a fitted mix, and how near its domains' token totals came to the targets."""

    domains: tuple[str, ...]
    least: float
    most: float
    steps: list[tuple[float, ...]] = field(default_factory=list)
    expected: tuple[float, ...] = ()
    targets: tuple[float, ...] = ()

    def shares(self) -> list[tuple[str, float, float]]:
        """(domain, target, expected) shares of the tokens; where limits or steps end the fit short of the targets, this shows it."""
        totals = [sum(x) or 1.0 for x in (self.targets, self.expected)]
        return [(d, t / totals[0], e / totals[1]) for d, t, e in zip(self.domains, self.targets, self.expected)]

    def rate(self, posterior: Column) -> Column:
        """The rate of a document with this posterior."""
        start = F.lit(min(max(1.0, self.least), self.most))
        if not self.steps:
            return start
        # The steps are data: written out, each one more would make code of its own to compile, here and on all executors.
        steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in self.steps])

        def moved(rate: Column, step: Column) -> Column:
            move = sum((F.get(posterior, F.lit(k)) * F.get(step, F.lit(k)) for k in range(len(self.domains))), F.lit(0.0))
            return F.least(F.lit(self.most), F.greatest(F.lit(self.least), rate - move))

        return F.aggregate(steps, start, moved)


def fit_mix(
    members: DataFrame,
    domains: Sequence[str],
    weights: Mapping[str, float],
    least: float = 0.0,
    most: float = 4.0,
    keep_all: bool = False,
    max_steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
) -> Mix:
    """Rates within [``least``, ``most``] for ``members`` (``__tokens``, ``__p``).

    The aim is the least sum over domains of (expected - target tokens)^2 from
    rate 1 on. A step moves each rate along its posterior, so that it stays an
    expression of it, and is then projected into the limits. The gradient is
    scaled by the inverse of the domains' token overlap among the documents
    whose rates can still move, which without limits is exact in one step;
    where that did not bring the totals nearer, the next step is scaled by the
    domains' tokens instead, which never overshoots. The total is what is
    there, or, with ``keep_all``, as much as the most over-represented domain
    needs to keep all it has. Domains without tokens are left out of the aim.
    No documents: no steps.
    """
    mix = Mix(tuple(domains), least, most)
    n = range(len(domains))
    share = np.array([weights[d] for d in domains]) / sum(weights.values())
    base, best, safe = None, np.inf, False
    while True:
        rated = members.select("__tokens", "__p", staged(mix.rate(F.col("__p"))).alias("__rate"))
        part = [F.col("__tokens").cast("double") * F.get("__p", F.lit(k)) for k in n]
        loose = F.when((F.col("__rate") > least) & (F.col("__rate") < most), 1.0).otherwise(0.0 if mix.steps else 1.0)
        sums = rated.agg(
            *[F.sum(part[k] * F.col("__rate")) for k in n],
            *[F.sum(part[k] * F.get("__p", F.lit(j)) * loose) for k in n for j in n],
        ).first()
        found = np.array([float(x or 0.0) for x in sums])
        now, overlap = found[: len(n)], found[len(n) :].reshape(len(n), len(n))
        if base is None:
            base = overlap.sum(axis=1)
            live = base > 0
            if not live.any():
                return mix
            total = max(base[live & (share > 0)] / share[live & (share > 0)], default=base.sum()) if keep_all else base.sum()
            mix.targets = tuple(float(x) for x in share * total)
        mix.expected = tuple(float(x) for x in now)
        off = np.where(live, now - np.array(mix.targets), 0.0)
        error = float(np.abs(off).max() / sum(mix.targets))
        if error <= tolerance or len(mix.steps) == max_steps:
            break
        # A step that brought little is followed by a safe one; a safe one that did ends the search.
        slow = error > 0.9 * best
        if slow and safe and error > 0.999 * best:
            break
        safe, best = slow, min(best, error)
        step = off / np.where(live, base, 1.0)
        if not safe:
            ridge = 1e-6 * base.max() * np.eye(len(n))
            step = np.where(live, np.linalg.solve(overlap + ridge, off), 0.0)
        mix.steps.append(tuple(float(x) for x in step))
    return mix


def mixing_report(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    **limits: float,
) -> DataFrame:
    """(doc, n_tokens, posterior, rate, copies, mix) per row: copies is the rate rounded up or down by a hash of id and text.

    ``mix`` lists (domain, target, expected) shares of the tokens, in every row the same. Null and empty texts have no tokens; they get a rate all the same. Equal
    rows get equal results. An empty table gives no rows.
    """
    model = fit_domains(docs, labelled, sorted(weights), id_col=id_col, text_col=text_col)
    keyed = docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("digest"), F.col(f"`{text_col}`").alias("text")
    )
    members = checkpointed(model.posteriors(keyed).drop("text"))
    mix = fit_mix(members, model.domains, weights, **limits)
    rated = members.withColumn("rate", mix.rate(F.col("__p")))
    known = [F.struct(F.lit(d).alias("domain"), F.lit(t).alias("target"), F.lit(e).alias("expected")) for d, t, e in mix.shares()]
    shares = F.array(*known).cast("array<struct<domain:string,target:double,expected:double>>")
    return rated.select(
        "doc",
        F.col("__tokens").alias("n_tokens"),
        F.col("__p").alias("posterior"),
        "rate",
        _copies(F.col("rate"), F.col("doc"), F.col("digest")).alias("copies"),
        shares.alias("mix"),
    )


def _copies(rate: Column, doc: Column, digest: Column) -> Column:
    draw = F.shiftrightunsigned(F.xxhash64(doc, digest, F.lit("copies")), 11).cast("double") / float(1 << 53)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_documents(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    **limits: float,
) -> DataFrame:
    """``docs`` with each row as often as its copies say, and the columns it had.

    Fitting scans the texts once and applying once more; neither shuffles them.
    """
    columns = docs.columns
    model = fit_domains(docs, labelled, sorted(weights), id_col=id_col, text_col=text_col)
    members = checkpointed(model.posteriors(docs.select(F.col(f"`{text_col}`").alias("text"))).select("__tokens", "__p"))
    mix = fit_mix(members, model.domains, weights, **limits)
    copies = _copies(F.col("__rate"), F.col(f"`{id_col}`"), F.xxhash64(f"`{text_col}`"))
    rated = model.posteriors(docs, text_col).withColumn("__rate", staged(mix.rate(F.col("__p"))))
    repeated = rated.withColumn("__copies", copies).filter("__copies > 0")
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in columns])
