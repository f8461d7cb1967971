"""Full-coverage grading: every patch of a slide in exactly one crop, one kernel pass for all crops.

A crop is ``bag_size`` patches of a slide in the order of patch_idx, which may have gaps. Where crops begin is found from keys
alone. Tasks then look up the crop of each patch and add up numerators and masses per (slide, crop). A crop that
lies whole in one task, which is nearly every one when the store keeps slides together, leaves it as a few logits; only parts of
crops that are split over tasks are exchanged, as sums. Vectors never are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.functions import ordinal
from bagspark.operators.bags import positions
from bagspark.operators.cohort import CohortError, check_cohort
from bagspark.operators.metrics import crop_average, ensemble_predict, prediction_record
from bagspark.plans.evaluate import evaluate_locked
from bagspark.plans.scoring import EPS, Weights, _all_scores, _check_size, _matrix, _offsets, mlp_head
from bagspark.session import materialise
from bagspark.skew import turns

CROPS_AT_ONCE = 4_000_000
"""So many crop starts, 24 bytes each, are shipped to the tasks at once; more are taken in turns by ranges of slides."""


def crop_bounds(patches: DataFrame, bag_size: int, slides: DataFrame | None = None) -> DataFrame:
    """(slide_id, crop, first_patch, n): the smallest patch_idx and the size of every crop, of ``slides`` or all. Reads keys only."""
    if bag_size < 1:
        raise ValueError("a crop holds one patch at least")
    keys = patches.select("slide_id", "patch_idx")
    if slides is not None:
        keys = keys.join(slides.select("slide_id").distinct(), "slide_id", "left_semi")
    placed = positions(keys).withColumn("crop", F.expr(f"position div {bag_size}"))
    return placed.groupBy("slide_id", "crop").agg(F.min("patch_idx").alias("first_patch"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Starts:
    """Crop starts of some slides, sorted by (slide, crop)."""

    slides: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, bounds: DataFrame) -> Starts:
        rows = bounds.select("slide_id", "first_patch", "n").orderBy("slide_id", "crop").toArrow()
        return cls(rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy())

    def crops(self, slide, patch_idx: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The crop of each patch and the sizes of all crops of a slide; None for a slide that is not asked for."""
        lo, hi = bisect_left(self.slides, slide), bisect_right(self.slides, slide)
        return (np.searchsorted(self.first[lo:hi], patch_idx, side="right") - 1, self.size[lo:hi]) if hi > lo else None


def crop_parts(
    patches: DataFrame, models: Sequence[Weights], starts: Starts, stride: int = 64, n_offsets: int | None = None, clustered: bool = False
) -> DataFrame:
    """The kernel pass. A crop seen whole: one row per model with its mean ``logits``; else a row of sums per (model, offset, branch)."""
    _check_size(models)
    slide_type = patches.schema["slide_id"].dataType.simpleString()
    shift = max(m.bound for m in models)
    arrow_slide = pa.string() if slide_type == "string" else pa.int32() if slide_type == "int" else pa.int64()
    shipped = patches.sparkSession.sparkContext.broadcast(starts)
    names = ["slide_id", "crop", "n", "model", "offset_no", "branch", "mass", "total", "logits"]
    lists = pa.list_(pa.float64())
    kinds = [arrow_slide, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), lists, lists]

    def leave(slide, crop: int, n: int, whole: bool, mass: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        if whole:
            bags = (total / mass[..., None]).mean(axis=2)  # [models, offsets, dim]
            rows = [(slide, crop, n, m, None, None, None, None, models[m].head(bags[m]).mean(axis=0)) for m in range(len(models))]
        else:
            rows = [(slide, crop, n, m, o, b, mass[m, o, b], total[m, o, b], None) for m, o, b in np.ndindex(mass.shape)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        now, sums = None, None
        for batch in batches:
            slides, idx = batch.column("slide_id").to_pylist(), batch.column("patch_idx").to_numpy()
            edges = [k for k in range(1, len(slides)) if slides[k] != slides[k - 1]]
            crop, asked, sizes = np.full(len(slides), -1), np.zeros(len(slides), bool), {}
            for lo, hi in zip([0, *edges], [*edges, len(slides)]):
                if lo < hi and (found := known.crops(slides[lo], idx[lo:hi])) is not None:
                    crop[lo:hi], asked[lo:hi], sizes[slides[lo]] = found[0], True, found[1]
            rows = np.flatnonzero(asked)
            if not len(rows):
                continue
            x = _matrix(batch.column("features").take(pa.array(rows)))
            e = np.exp(_all_scores(x, models, _offsets(x.shape[1], models, stride, n_offsets)) - shift)
            centred = x - x.mean(axis=1, keepdims=True)
            h = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + EPS)
            keys = [(slides[r], int(crop[r])) for r in rows]
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = [hi - lo, e[lo:hi].sum(axis=0), np.einsum("nmob,nd->mobd", e[lo:hi], h[lo:hi], optimize=True)]
                if keys[lo] != now:
                    if now is not None:
                        yield leave(*now, sums[0], sums[0] == expected, *sums[1:])
                    now, expected, sums = keys[lo], int(sizes[keys[lo][0]][keys[lo][1]]), part
                else:
                    sums = [a + b for a, b in zip(sums, part)]
        if now is not None:
            yield leave(*now, sums[0], sums[0] == expected, *sums[1:])

    narrow = patches.select("slide_id", "patch_idx", "features")
    placed = narrow if clustered else narrow.sortWithinPartitions("slide_id", "patch_idx")
    schema = f"slide_id {slide_type}, crop long, n long, model int, offset_no int, branch int, mass double, total array<double>, logits array<double>"
    return placed.mapInArrow(run, schema)


def crop_predictions(
    patches: DataFrame, models: Sequence[Weights], bag_size: int = 2048, stride: int = 64, n_offsets: int | None = None, n_classes: int = 3,
    clustered: bool = False, slides: DataFrame | None = None,
) -> DataFrame:
    """(slide_id, crop, model, n, cumulative): what every model says about every crop; logits are averaged over offsets.

    Slides are those in ``slides``, or all. Patches that repeat a patch_idx are in one crop. ``clustered`` states that rows come slide by
    slide in the order of patch_idx, as the feature store writes them, and saves a sort inside tasks; the result is the same.
    """
    bounds = materialise(crop_bounds(patches, bag_size, slides), "crop_bounds")
    parts = None
    for lo, hi in turns(bounds.select("slide_id", "crop"), "slide_id", ["slide_id", "crop"], CROPS_AT_ONCE):
        inside = F.lit(True) if lo is None else F.col("slide_id").between(lo, hi)
        part = crop_parts(patches.where(inside), models, Starts.of(bounds.where(inside)), stride, n_offsets, clustered)
        parts = part if parts is None else parts.unionByName(part)
    parts = materialise(parts, "crop_parts")
    split = parts.where(F.col("logits").isNull())
    per_map = split.groupBy("slide_id", "crop", "model", "offset_no", "branch").agg(
        F.sum("mass").alias("mass"), F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total"), F.lit(1.0)).alias("total")
    )
    scaled = F.transform(vector_to_array("total"), lambda v: v / F.col("mass"))
    bags = per_map.select("slide_id", "crop", "model", "offset_no", "n", array_to_vector(scaled).alias("v")).groupBy("slide_id", "crop", "model", "offset_no").agg(
        F.max("n").alias("n"), Summarizer.mean(F.col("v"), F.lit(1.0)).alias("v")
    )
    graded = mlp_head(bags.withColumn("bag", vector_to_array("v")).drop("v"), models)
    mean = F.array(*[F.avg(F.col("logits")[j]) for j in range(n_classes - 1)]).alias("logits")
    joined = graded.groupBy("slide_id", "crop", "model").agg(F.max("n").alias("n"), mean)
    whole = parts.where(F.col("logits").isNotNull()).select("slide_id", "crop", "model", "n", "logits")
    rows = whole.unionByName(joined.select("slide_id", "crop", "model", "n", "logits"))
    return rows.select("slide_id", "crop", "model", "n", ordinal.corn_cumulative("logits", n_classes).alias("cumulative"))


def score_crops(
    patches: DataFrame, models: Sequence[Weights], bag_size: int = 2048, stride: int = 64, n_offsets: int | None = None, n_classes: int = 3,
    clustered: bool = False, slides: DataFrame | None = None,
) -> DataFrame:
    """One prediction record per slide: cumulative probabilities averaged over crops, then over models. The mean of rank-consistent
    sequences is rank-consistent, which a mean of logits would not be."""
    crops = crop_predictions(patches, models, bag_size, stride, n_offsets, n_classes, clustered, slides)
    return prediction_record(ensemble_predict(crop_average(crops, n_classes), n_classes), n_classes=n_classes)


def evaluate_crops(
    patches: DataFrame, models: Sequence[Weights], splits: DataFrame, bag_size: int = 2048, unlock: bool = False, bootstrap: int = 2000,
    stride: int = 64, n_offsets: int | None = None, n_classes: int = 3, clustered: bool = False, inventory: DataFrame | None = None,
) -> DataFrame:
    """The locked evaluation at full coverage: only test slides are scored, and nothing is read before ``unlock`` is given.

    With an ``inventory`` of the store the test cohort is checked first: one width, one encoder, no slide missing."""
    if not unlock:
        return evaluate_locked(patches, splits, unlock)
    test = splits.where("is_test").select(F.col("patient_id").alias("slide_id"))
    if inventory is not None and (found := check_cohort(test, inventory))["missing"]:
        raise CohortError(f"{found['missing']} test slides have no features, e.g. {found['missing_first']}")
    crops = crop_predictions(patches, models, bag_size, stride, n_offsets, n_classes, clustered, test)
    cums = materialise(crop_average(crops, n_classes).withColumnRenamed("slide_id", "patient_id"), "crop_cums")
    return evaluate_locked(cums, splits, unlock, bootstrap, n_classes)
