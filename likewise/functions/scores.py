"""Column arithmetic for association and matching scores (JVM-side only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are compared after rounding to this many units per 1.0, so that the
#: noise of floating-point summation order can never reorder two equal scores.
MICRO = 1_000_000


def fixed6(value: Column) -> Column:
    """Round to six decimals with plain double arithmetic (no decimals involved)."""
    return F.floor(value * F.lit(float(MICRO)) + F.lit(0.5)) / F.lit(float(MICRO))


def x_ln_x(x: Column) -> Column:
    """``x * ln(x)``, continued with 0 at 0."""
    x = x.cast("double")
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def log_likelihood_ratio(both: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's G2 of a 2x2 table given by its margins.

    ``both`` users have A and B, ``n_a`` have A, ``n_b`` have B, ``n`` exist.
    Rounding noise below zero is cut off at 0.
    """
    cells = (
        x_ln_x(both)
        + x_ln_x(n_a - both)
        + x_ln_x(n_b - both)
        + x_ln_x(n - n_a - n_b + both)
    )
    margins = x_ln_x(n_a) + x_ln_x(n - n_a) + x_ln_x(n_b) + x_ln_x(n - n_b)
    return F.greatest(F.lit(0.0), F.lit(2.0) * (x_ln_x(n) + cells - margins))


def inverse_frequency(n_docs: Column, doc_freq: Column) -> Column:
    """Weight of a term found in ``doc_freq`` of the ``n_docs`` items having its field."""
    return F.ln(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))
