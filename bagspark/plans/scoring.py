"""Grading slides from patch vectors: gated attention scores, pooled bags, head, attention map.

Patch vectors are never shuffled. Scores are bounded by construction (tanh times sigmoid), so
exp(score - bound) cannot overflow and the softmax needs no pass for the maximum: tasks add up
numerators and denominators for runs of patches of one slide, and only these sums move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.functions import ordinal
from bagspark.functions.vectors import window_offsets
from bagspark.operators.attention import map_summary
from bagspark.operators.bags import pick_offsets
from bagspark.operators.metrics import crop_average, ensemble_predict, prediction_record
from bagspark.session import materialise
from bagspark.skew import attach_stats

MAX_WEIGHT_BYTES = 256 * 1024 * 1024
EPS = 1e-5


def erf(x: np.ndarray) -> np.ndarray:
    """The error function by its series with positive terms, so nothing cancels; beyond 6 it is 1 to double precision."""
    a = np.minimum(np.abs(x), 6.0)
    term = total = a
    n = 0
    while np.any(term > total * 1e-17):
        term = term * (2 * a * a) / (2 * n + 3)
        total = total + term
        n += 1
    return np.sign(x) * np.minimum(total * np.exp(-a * a) * (2 / math.sqrt(math.pi)), 1.0)


@dataclass(frozen=True)
class Weights:
    """One trained model: gated scorer (value, gate, score) and head, as [in, out] matrices."""

    value: np.ndarray
    gate: np.ndarray
    score: np.ndarray
    head_in: np.ndarray
    head_out: np.ndarray
    value_bias: np.ndarray = field(default_factory=lambda: np.zeros(1))
    gate_bias: np.ndarray = field(default_factory=lambda: np.zeros(1))
    score_bias: np.ndarray = field(default_factory=lambda: np.zeros(1))
    head_in_bias: np.ndarray = field(default_factory=lambda: np.zeros(1))
    head_out_bias: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @property
    def window(self) -> int:
        return self.value.shape[0]

    @property
    def branches(self) -> int:
        return self.score.shape[1]

    @property
    def bound(self) -> float:
        """No score exceeds this absolute value."""
        return float(np.abs(self.score).sum(axis=0).max() + np.abs(self.score_bias).max())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """[n, window] -> [n, branches]"""
        value = np.tanh(x @ self.value + self.value_bias)
        gate = 1.0 / (1.0 + np.exp(-(x @ self.gate + self.gate_bias)))
        return (value * gate) @ self.score + self.score_bias

    def head(self, bags: np.ndarray) -> np.ndarray:
        """[n, dim] -> logits [n, classes - 1] through an exact GELU."""
        hidden = bags @ self.head_in + self.head_in_bias
        return (0.5 * hidden * (1.0 + erf(hidden / math.sqrt(2.0)))) @ self.head_out + self.head_out_bias


def random_weights(dim: int, window: int, hidden: int, branches: int, n_classes: int = 3, seed: int = 0) -> Weights:
    """An untrained model: every layer uniform within 1/sqrt(fan-in)."""
    rng = np.random.default_rng(seed)

    def layer(fan_in: int, out: int) -> tuple[np.ndarray, np.ndarray]:
        limit = 1.0 / math.sqrt(fan_in)
        return rng.uniform(-limit, limit, (fan_in, out)), rng.uniform(-limit, limit, out)

    v, vb = layer(window, hidden)
    g, gb = layer(window, hidden)
    s, sb = layer(hidden, branches)
    h, hb = layer(dim, hidden)
    o, ob = layer(hidden, n_classes - 1)
    return Weights(v, g, s, h, o, vb, gb, sb, hb, ob)


def _check_size(models: Sequence[Weights]) -> None:
    total = sum(np.asarray(v).nbytes for m in models for v in vars(m).values())
    if total > MAX_WEIGHT_BYTES:
        raise ValueError(f"model weights take {total} bytes, more than is shipped to every task")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a float64 matrix; all rows must have one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    if n and len(flat) % n:
        raise ValueError("patch vectors of different widths")
    return flat.reshape(n, -1)


def _windows(x: np.ndarray, window: int, offsets: Sequence[int]) -> Iterator[np.ndarray]:
    span = np.arange(window)
    for offset in offsets:
        yield x[:, (offset + span) % x.shape[1]]


def _all_scores(x: np.ndarray, models: Sequence[Weights], offsets: Sequence[int]) -> np.ndarray:
    """[n, models, offsets, branches]"""
    wrong = [m.head_in.shape[0] for m in models if m.head_in.shape[0] != x.shape[1]]
    if wrong:
        raise ValueError(f"patch vectors have width {x.shape[1]}, models expect {wrong[0]}: another encoder or pooling")
    return np.stack([np.stack([m.scores(w) for w in _windows(x, m.window, offsets)], axis=1) for m in models], axis=1)


def _offsets(dim: int, models: Sequence[Weights], stride: int, n_offsets: int | None) -> list[int]:
    return pick_offsets(window_offsets(dim, models[0].window, stride), n_offsets)


def score_arrays(
    patches: DataFrame, models: Sequence[Weights], stride: int = 64, n_offsets: int | None = None
) -> DataFrame:
    """(slide_id, patch_idx, scores): scores flattened over (model, offset, branch), raw vectors in."""
    _check_size(models)
    types = {f.name: f.dataType.simpleString() for f in patches.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("features"))
            if not len(x):
                continue
            flat = _all_scores(x, models, _offsets(x.shape[1], models, stride, n_offsets)).reshape(len(x), -1)
            width = flat.shape[1]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), pa.array(flat.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("slide_id"), batch.column("patch_idx"), lists], ["slide_id", "patch_idx", "scores"]
            )

    narrow = patches.select("slide_id", "patch_idx", "features")
    return narrow.mapInArrow(
        run, f"slide_id {types['slide_id']}, patch_idx {types['patch_idx']}, scores array<double>"
    )


def gated_scores(patches: DataFrame, weights: Weights, stride: int = 64, n_offsets: int | None = None) -> DataFrame:
    """Long (slide_id, patch_idx, offset_no, branch, score) of one model."""
    b = weights.branches
    return (
        score_arrays(patches, [weights], stride, n_offsets)
        .select("slide_id", "patch_idx", F.posexplode("scores").alias("_p", "score"))
        .select(
            "slide_id", "patch_idx", F.floor(F.col("_p") / b).cast("int").alias("offset_no"),
            (F.col("_p") % b).alias("branch"), "score",
        )
    )


def slide_bags(
    patches: DataFrame, models: Sequence[Weights], stride: int = 64, n_offsets: int | None = None, clustered: bool = False
) -> DataFrame:
    """(slide_id, model, offset_no, bag): layer-normed vectors under softmax attention, branch mean.

    Partitions are sorted by slide locally, so a task sends one sum per (slide, map) it saw.
    ``clustered`` skips that sort for rows that come slide by slide, as the feature store writes
    them; the result is the same either way.
    """
    _check_size(models)
    slide_type = patches.schema["slide_id"].dataType.simpleString()
    shift = max(m.bound for m in models)
    schema = f"slide_id {slide_type}, model int, offset_no int, branch int, mass double, total array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        current, mass, total = None, None, None

        def flush() -> pd.DataFrame:
            m, o, b = (i.ravel() for i in np.indices(mass.shape))
            return pd.DataFrame(
                {
                    "slide_id": [current] * mass.size, "model": m.astype(np.int32), "offset_no": o.astype(np.int32),
                    "branch": b.astype(np.int32), "mass": mass.ravel(), "total": list(total.reshape(mass.size, -1)),
                }
            )

        for batch in batches:
            x = _matrix(batch.column("features"))
            if not len(x):
                continue
            e = np.exp(_all_scores(x, models, _offsets(x.shape[1], models, stride, n_offsets)) - shift)
            centred = x - x.mean(axis=1, keepdims=True)
            h = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + EPS)
            slides = batch.column("slide_id").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, slides[1:] != slides[:-1], True])
            for lo, hi in zip(edges[:-1], edges[1:]):
                part_mass = e[lo:hi].sum(axis=0)
                part = np.einsum("nmob,nd->mobd", e[lo:hi], h[lo:hi], optimize=True)
                if slides[lo] == current:
                    mass, total = mass + part_mass, total + part
                else:
                    if current is not None:
                        yield flush()
                    current, mass, total = slides[lo], part_mass, part
        if current is not None:
            yield flush()

    def run_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    narrow = patches.select("slide_id", "features")
    partial = (narrow if clustered else narrow.sortWithinPartitions("slide_id")).mapInArrow(run_arrow, schema)
    per_map = partial.groupBy("slide_id", "model", "offset_no", "branch").agg(
        F.sum("mass").alias("mass"), Summarizer.sum(array_to_vector("total"), F.lit(1.0)).alias("total")
    )
    scaled = F.transform(vector_to_array("total"), lambda v: v / F.col("mass"))
    bags = per_map.select("slide_id", "model", "offset_no", array_to_vector(scaled).alias("v")).groupBy(
        "slide_id", "model", "offset_no"
    ).agg(Summarizer.mean(F.col("v"), F.lit(1.0)).alias("v"))
    return bags.select("slide_id", "model", "offset_no", vector_to_array("v").alias("bag"))


def mlp_head(bags: DataFrame, models: Sequence[Weights]) -> DataFrame:
    """Adds ``logits`` to (model, bag) rows: linear, GELU, linear."""
    _check_size(models)

    @F.pandas_udf("array<double>")
    def head(bag: pd.Series, model: pd.Series) -> pd.Series:
        x, chosen = np.stack(bag.to_numpy()), model.to_numpy()
        logits = np.empty(len(x), object)
        for k in np.unique(chosen):
            at = np.flatnonzero(chosen == k)
            for row, values in zip(at, models[k].head(x[at])):
                logits[row] = values
        return pd.Series(logits)

    return bags.withColumn("logits", head("bag", "model"))


def patch_attention(
    patches: DataFrame, models: Sequence[Weights], stride: int = 64, n_offsets: int | None = None
) -> DataFrame:
    """(slide_id, patch_idx, n, alpha): softmax maps averaged over branches, offsets and models, sum 1;
    ``n`` is the number of patches of the slide. Vectors are scored once; the narrow scores are written and read again."""
    shift = max(m.bound for m in models)
    scored = materialise(score_arrays(patches, models, stride, n_offsets), "scores")
    scored = scored.select("slide_id", "patch_idx", F.transform("scores", lambda s: F.exp(s - F.lit(shift))).alias("e"))
    mass = scored.groupBy("slide_id").agg(
        Summarizer.sum(array_to_vector("e"), F.lit(1.0)).alias("mass"), F.count(F.lit(1)).alias("n")
    ).select("slide_id", vector_to_array("mass").alias("mass"), "n")
    rows = attach_stats(scored, mass, ["slide_id"], ["patch_idx"])
    shares = F.zip_with("e", "mass", lambda e, m: e / m)
    return rows.select("slide_id", "patch_idx", "n", (ordinal.array_sum(shares) / F.size("e")).alias("alpha"))


def score_slides(
    patches: DataFrame, models: Sequence[Weights], stride: int = 64, n_offsets: int | None = None, n_classes: int = 3,
    clustered: bool = False,
) -> DataFrame:
    """One prediction record per slide: logits averaged over offsets, cumulative over models."""
    logits = mlp_head(slide_bags(patches, models, stride, n_offsets, clustered), models)
    mean = F.array(*[F.avg(F.col("logits")[j]) for j in range(n_classes - 1)]).alias("logits")
    per_model = logits.groupBy("slide_id", "model").agg(mean)
    cums = per_model.select("slide_id", "model", ordinal.corn_cumulative("logits", n_classes).alias("cumulative"))
    return prediction_record(ensemble_predict(cums, n_classes), n_classes=n_classes)


def subspace_maps(patches: DataFrame, weights: Weights, stride: int = 64) -> DataFrame:
    """(slide_id, patch_idx, k, alpha): one map per offset, softmax averaged over branches.

    Vectors are scored once; all that is derived from the maps reads the written scores."""
    shift = weights.bound
    scored = materialise(score_arrays(patches, [weights], stride), "scores")
    scored = scored.select("slide_id", "patch_idx", F.transform("scores", lambda s: F.exp(s - F.lit(shift))).alias("e"))
    mass = scored.groupBy("slide_id").agg(
        Summarizer.sum(array_to_vector("e"), F.lit(1.0)).alias("mass"), F.count(F.lit(1)).alias("n")
    ).select("slide_id", vector_to_array("mass").alias("mass"), "n")
    rows = attach_stats(scored, mass, ["slide_id"], ["patch_idx"])
    shares = F.zip_with("e", "mass", lambda e, m: e / m)
    b = weights.branches
    per_offset = F.transform(
        F.sequence(F.lit(0), (F.size("s") / b).cast("int") - 1),
        lambda o: ordinal.array_sum(F.slice("s", o * b + 1, b)) / b,
    )
    return rows.withColumn("s", shares).select(
        "slide_id", "patch_idx", F.posexplode(per_offset).alias("k", "alpha")
    )


def audit_arms(summaries: dict[str, DataFrame]) -> DataFrame:
    """(arm, n, peakedness, correlation, ensembled, more_peaked): arm means over slide summaries.

    ``more_peaked`` says whether the trained arm beats the control, the only evidence that counts.
    """
    rows = None
    for arm, df in summaries.items():
        row = df.agg(
            F.lit(arm).alias("arm"), F.count(F.lit(1)).alias("n"), F.avg("peakedness").alias("peakedness"),
            F.avg("correlation").alias("correlation"), F.avg("ensembled").alias("ensembled"),
        )
        rows = row if rows is None else rows.unionByName(row)
    verdict = rows.groupBy(F.lit(1).alias("_one")).agg(
        (F.max(F.when(F.col("arm") == "trained", F.col("peakedness")))
         > F.max(F.when(F.col("arm") == "control", F.col("peakedness")))).alias("more_peaked")
    )
    return rows.withColumn("_one", F.lit(1)).join(verdict, "_one").drop("_one")


def attention_audit(
    patches: DataFrame, trained: Weights, control: Weights | None = None, control_seed: int = 0, stride: int = 64
) -> DataFrame:
    """Compare a trained scorer's maps with those of an untrained one on the same slides."""
    if control is None:
        control = random_weights(
            trained.head_in.shape[0], trained.window, trained.value.shape[1], trained.branches,
            trained.head_out.shape[1] + 1, control_seed,
        )
    return audit_arms(
        {
            "trained": map_summary(subspace_maps(patches, trained, stride)),
            "control": map_summary(subspace_maps(patches, control, stride)),
        }
    )
