"""Mixing to target weights with soft membership.

A classifier that has learnt from a labelled table says how likely a document belongs to each
domain. Rates, how often a document is to be taken, are fitted so that the expected tokens of
every domain meet their target: nonnegative least squares by projected gradient descent with
momentum. A step needs one sum for each domain over all documents; a document's rate follows
from its own row and the sums so far, so every task works the rates out anew, and the driver
holds nothing but a few numbers for each step.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.functions.hashing import uniform
from likewise.llm import text as tx
from likewise.llm.workers import begin
from likewise.sources.staging import stage

#: Labelled rows that the classifier learns from.
SAMPLE = 20_000

#: Buckets into which words are hashed.
BUCKETS = 1 << 14

#: The fit ends when every domain is this close to its target, as a share of all tokens.
TOLERANCE = 1e-4
STEPS = 60


def _words(text: Column) -> Column:
    return F.array_remove(F.split(tx.whole(text), r"[\x20\x09-\x0D]+", -1), "")


def learn(
    docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE
) -> PipelineModel | None:
    """A classifier of documents into domains, from (doc_id, domain) rows.

    Rows of other or no domain are left out; of the rest, at most ``sample`` with the smallest
    hashed ids are learnt from. None if these have fewer than two domains.
    """
    known = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = stage(
        known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample), "mixing-chosen"
    )
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    rows = stage(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
        .select(number.cast("double").alias("label"), _words(F.col("text")).alias("words")),
        "mixing-examples",
    )
    if rows.select("label").distinct().count() < 2:
        return None
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=BUCKETS)
    scaled = Normalizer(inputCol="counts", outputCol="features")
    model = LogisticRegression(
        family="multinomial", maxIter=40, regParam=1e-3, probabilityCol="probability"
    )
    return Pipeline(stages=[counts, scaled, model]).fit(rows)


def memberships(docs: DataFrame, model: PipelineModel | None, domains: list[str]) -> DataFrame:
    """(doc_id, tokens, posterior): words of the whole text, and a probability per domain."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), _words(F.col("text")).alias("words")
    )
    tokens = F.size("words").cast("bigint")
    if model is None:
        even = F.array(*[F.lit(1 / len(domains))] * len(domains))
        return rows.select("doc_id", tokens.alias("tokens"), even.alias("posterior"))
    n = len(domains)
    # Domains without an example have no probability from the classifier. The probabilities must not
    # be named inside a lambda: it would run the whole classifier once for each domain.
    full = F.slice(F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), n)), 1, n)
    return model.transform(rows).select("doc_id", tokens.alias("tokens"), full.alias("posterior"))


class Steps:
    """The steps so far: what each document's rate follows from."""

    def __init__(self, size: float) -> None:
        self.size = size
        self.residuals: list[np.ndarray] = []
        self.momenta: list[float] = []

    def add(self, residual: np.ndarray) -> None:
        n = len(self.residuals)
        self.residuals.append(residual)
        self.momenta.append(n / (n + 3))

    def rates(self, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates, and the point ahead of them at which the next gradient is taken."""
        rate = ahead = np.ones(len(posterior))
        for residual, momentum in zip(self.residuals, self.momenta, strict=True):
            last, rate = rate, np.maximum(0, ahead - self.size * (posterior @ residual))
            ahead = np.maximum(0, rate + momentum * (rate - last))
        return rate, ahead


def _matrix(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def _totals(members: DataFrame, steps: Steps, domains: int) -> np.ndarray:
    """Expected tokens of the domains at the rates and at the point ahead of them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("mixing")
        total = np.zeros((2, domains))
        for batch in batches:
            posterior = _matrix(batch.column("posterior"), domains)
            tokens = batch.column("tokens").to_numpy()
            for row, rate in enumerate(steps.rates(posterior)):
                total[row] += (tokens * rate) @ posterior
        yield pa.RecordBatch.from_pylist(
            [{"at": i, "total": float(x)} for i, x in enumerate(total.ravel())]
        )

    sums = members.select("tokens", "posterior").mapInArrow(of, "at long, total double")
    out = np.zeros(2 * domains)
    for row in sums.groupBy("at").agg(F.sum("total").alias("total")).collect():
        out[row["at"]] = row["total"]
    return out.reshape(2, domains)


def fit_rates(
    members: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE
) -> Steps:
    """Rates for expected totals as close to the targets as nonnegative rates allow.

    A rate's step is scaled by the document's tokens, so long documents don't take it all.
    """
    n = len(targets)
    p = F.col("posterior")
    gram = members.agg(
        *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    ).first()
    matrix = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            matrix[i, j] = matrix[j, i] = gram[f"g{i}_{j}"] or 0.0
    largest = np.linalg.eigvalsh(matrix)[-1]
    done = Steps(1 / largest if largest > 0 else 0.0)
    enough = tolerance * max(targets.sum(), 1.0)
    for _ in range(steps):
        now, ahead = _totals(members, done, n)
        if np.abs(now - targets).max() <= enough:
            break
        done.add(ahead - targets)
    return done


def with_rates(members: DataFrame, steps: Steps, domains: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("mixing")
        for batch in batches:
            rate, _ = steps.rates(_matrix(batch.column("posterior"), domains))
            yield batch.append_column("rate", pa.array(rate))

    return members.mapInArrow(of, "doc_id long, tokens long, posterior array<double>, rate double")


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float],
    keep_all: bool = False,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, posterior (in the order of ``weights``), rate.

    The targets share out the tokens there are by the weights. With ``keep_all`` they share out
    as many more as it takes for no domain to shrink, so no rate falls below 1. A null text is
    an empty one: it has no tokens, and its rate follows from its posterior like any other. A
    null doc_id is kept. Without labelled rows of two domains all posteriors are even. An
    empty table gives an empty one. Other columns are not looked at.
    """
    domains = list(weights)
    share = np.array([weights[d] for d in domains], float)
    share = share / share.sum()
    model = learn(docs, labelled, domains, sample)
    members = stage(memberships(docs, model, domains), "mixing-members")
    now = _totals(members, Steps(0.0), len(domains))[0]
    total = now.sum()
    if keep_all:
        total = max(total, (now[share > 0] / share[share > 0]).max())
    steps = fit_rates(members, share * total)
    return with_rates(members, steps, len(domains))


def copies(rate: Column, *key: Column) -> Column:
    """How often a row is taken: the rate, its fraction decided by a hash of the key."""
    whole = F.floor(rate)
    return (whole + (uniform(11, *key) < rate - whole).cast("int")).cast("int")


def resample(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says and at least once, all columns as they are.

    A null doc_id is an id like any other; rows that repeat one come all as often as the row with
    the largest number. Null, empty and very long texts have their rates like any other. An empty
    table gives an empty one.
    """
    rates = mix(docs, labelled, weights, keep_all=True).select(
        F.col("doc_id").alias("id"), F.greatest(copies(F.col("rate"), F.col("doc_id")), F.lit(1)).alias("n")
    )
    own, n, turn = (tx.unused(docs, name) for name in ("_id", "_n", "_turn"))
    # Rows that repeat an id have the largest of their numbers.
    more = rates.groupBy(F.col("id").alias(own)).agg(F.max("n").alias(n)).where(F.col(n) > 1)
    more = stage(more, "mixing-repeated")
    same = docs["doc_id"].cast("bigint").eqNullSafe(more[own])
    taken = docs.join(more, same, "left")
    turns = F.sequence(F.lit(1), F.coalesce(n, F.lit(1)))
    return taken.select(*[docs[c] for c in docs.columns], F.explode(turns).alias(turn)).drop(turn)
