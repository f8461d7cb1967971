"""Ordinal grades from conditional logits (CORN, arXiv:2111.08851), as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commonly reported inter-observer agreement band.
AGREEMENT_BAND = (0.50, 0.70)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def corn_cumulative(logits: Column | str, n_classes: int | None = None) -> Column:
    """P(y > j) = product of the sigmoids up to j; never increases along the array.

    Here and below a known ``n_classes`` unrolls the array, which keeps the expression in
    generated code; without it any array length works.
    """
    z = _col(logits)
    if n_classes:
        out = [sigmoid(F.get(z, F.lit(0)))]
        for j in range(1, n_classes - 1):
            out.append(out[-1] * sigmoid(F.get(z, F.lit(j))))
        return F.array(*out)
    return F.transform(
        F.sequence(F.lit(1), F.size(z)),
        lambda i: F.aggregate(F.slice(z, F.lit(1), i), F.lit(1.0), lambda acc, x: acc * sigmoid(x)),
    )


def corn_class_probs(cumulative: Column | str, n_classes: int | None = None) -> Column:
    """Class posterior as differences of neighbouring cumulative probabilities, floored at 0."""
    cum = _col(cumulative)
    if n_classes:
        edges = [F.lit(1.0), *[F.get(cum, F.lit(j)) for j in range(n_classes - 1)], F.lit(0.0)]
        return F.array(*[F.greatest(a - b, F.lit(0.0)) for a, b in zip(edges, edges[1:])])
    return F.zip_with(
        F.concat(F.array(F.lit(1.0)), cum),
        F.concat(cum, F.array(F.lit(0.0))),
        lambda above, below: F.greatest(above - below, F.lit(0.0)),
    )


def corn_predict(cumulative: Column | str, threshold: float = 0.5, n_classes: int | None = None) -> Column:
    """Grade = number of cumulative probabilities strictly above the threshold."""
    cum = _col(cumulative)
    if n_classes:
        grade = F.lit(0)
        for j in range(n_classes - 1):
            grade = grade + F.when(F.get(cum, F.lit(j)) > threshold, 1).otherwise(0)
        return grade
    return F.size(F.filter(cum, lambda p: p > F.lit(threshold)))


def cumulative_targets(label: Column | str, n_classes: int = 3) -> Column:
    """[label > j] for j < K-1."""
    y = _col(label)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 2)), lambda j: F.when(y > j, 1.0).otherwise(0.0)
    )


def array_sum(values: Column | str) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x)


def expected_grade(probs: Column | str) -> Column:
    """Sum of k * p_k."""
    p = _col(probs)
    return array_sum(F.transform(p, lambda x, k: x * k))


def ambiguity(cumulative: Column | str) -> Column:
    """0 = decisive, 0.5 = on a grade boundary."""
    distance = F.transform(_col(cumulative), lambda p: F.abs(p - F.lit(0.5)))
    return F.lit(0.5) - F.array_min(distance)


def contextualise(
    kappa: Column | str, lo: float = AGREEMENT_BAND[0], hi: float = AGREEMENT_BAND[1]
) -> Column:
    k = _col(kappa)
    return (
        F.when(k.isNull(), F.lit(None).cast("string"))
        .when(k < lo, "below")
        .when(k <= hi, "inside")
        .otherwise("exceeds")
    )
