"""Ordinal training objectives evaluated over a table of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagspark.functions import ordinal


def _bce_with_logit(z: Column, t: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))


def _mean_present(values: list[Column]) -> Column:
    """Mean of the non-null columns, 0 when all are null."""
    packed = F.array_compact(F.array(*values))
    return F.when(F.size(packed) == 0, F.lit(0.0)).otherwise(ordinal.array_sum(packed) / F.size(packed))


def corn_loss(df: DataFrame, n_classes: int = 3, label: str = "y_true", logits: str = "logits") -> DataFrame:
    """Mean over tasks of binary cross-entropy on the conditional subset {y > j - 1}."""
    y = F.col(label)
    tasks = [
        F.avg(
            F.when(
                (y > j - 1) if j else F.lit(True),
                _bce_with_logit(F.col(logits)[j], F.when(y > j, 1.0).otherwise(0.0)),
            )
        )
        for j in range(n_classes - 1)
    ]
    names = [f"_t{j}" for j in range(n_classes - 1)]
    per = df.agg(*[t.alias(a) for t, a in zip(tasks, names)])
    return per.select(_mean_present([F.col(a) for a in names]).alias("corn"))


def corn_loss_soft(
    df: DataFrame, n_classes: int = 3, targets: str = "cum_targets", logits: str = "logits"
) -> DataFrame:
    """Cross-entropy on the cumulative probabilities themselves, for soft targets."""
    cum = ordinal.corn_cumulative(logits, n_classes)
    terms = []
    for j in range(n_classes - 1):
        p = F.least(F.greatest(F.get(cum, F.lit(j)), F.lit(1e-6)), F.lit(1 - 1e-6))
        t = F.col(targets)[j]
        terms.append(-(t * F.ln(p) + (F.lit(1.0) - t) * F.ln(F.lit(1.0) - p)))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return df.agg((F.avg(total) / (n_classes - 1)).alias("corn"))


def soft_qwk_loss(
    df: DataFrame, n_classes: int = 3, label: str = "y_true", probs: str = "probabilities"
) -> DataFrame:
    """Weighted disagreement of the soft confusion over the one expected from its marginals."""
    k = n_classes
    y, p = F.col(label), F.col(probs)
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.when(y == i, p[j])), F.lit(0.0)).alias(f"o{i}_{j}") for i in range(k) for j in range(k)],
        *[F.count_if(y == i).alias(f"t{i}") for i in range(k)],
        *[F.sum(p[j]).alias(f"p{j}") for j in range(k)],
    )

    def total(cells: list[Column]) -> Column:
        out = cells[0]
        for c in cells[1:]:
            out = out + c
        return out

    pairs = [(i, j, float((i - j) ** 2) / (k - 1) ** 2) for i in range(k) for j in range(k)]
    observed_mass = F.greatest(total([F.col(f"o{i}_{j}") for i, j, _ in pairs]), F.lit(1e-8))
    expected = {(i, j): F.col(f"t{i}") / F.col("n") * F.col(f"p{j}") / F.col("n") for i, j, _ in pairs}
    expected_mass = F.greatest(total(list(expected.values())), F.lit(1e-8))
    num = total([F.lit(w) * F.col(f"o{i}_{j}") for i, j, w in pairs]) / observed_mass
    den = F.greatest(total([F.lit(w) * expected[i, j] for i, j, w in pairs]) / expected_mass, F.lit(1e-8))
    return sums.select((num / den).alias("soft_qwk"))


def loss_report(
    parts: DataFrame,
    beta: float = 1.0,
    gamma: float = 0.1,
    lambda_qwk: float = 0.0,
    lambda_attn_entropy: float = 0.0,
    mixed: bool = False,
) -> DataFrame:
    """Weighted parts and total from one row (corn, soft_qwk, stabilisation, diversity, attn_entropy).

    Inactive parts are null; the raw entropy is always reported. Mixed batches have no hard
    labels, so the soft kappa sits out.
    """
    def part(name: str, weight: float, active: bool = True) -> Column:
        return (F.lit(weight) * F.col(name)) if active and weight > 0 else F.lit(None).cast("double")

    weighted = parts.select(
        F.col("corn").alias("corn"),
        part("soft_qwk", lambda_qwk, not mixed).alias("qwk"),
        part("stabilisation", beta).alias("stabilisation"),
        part("diversity", gamma).alias("diversity"),
        part("attn_entropy", lambda_attn_entropy).alias("attn_entropy"),
        F.col("attn_entropy").alias("attn_entropy_raw"),
    )
    active = ["corn", "qwk", "stabilisation", "diversity", "attn_entropy"]
    total = F.lit(0.0)
    for name in active:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    return weighted.withColumn("total", total)
