"""Order and moment statistics of the patch vectors of each slide, with vectors that stay where they are.

Tasks read their patches slide by slide and leave one accumulator per slide: counts, means, squared deviations, bounds and,
as if the slide were whole, its exact 90th percentile and the means of its extreme patches. If a slide has left just one
accumulator it was whole, and that is its result. Slides cut by task borders have theirs merged; their percentile is found by
histograms of fixed size between known bounds, refined until one value is left, and their extreme patches by
a threshold on (norm, patch_idx). So what is exchanged is accumulators, whatever the number of patches, and, for cut slides,
keys and norms. Vectors and components never are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bagspark.functions.vectors import l2_norm
from bagspark.session import materialise
from bagspark.skew import extreme_rows, turns

RUN_BYTES = 64 << 20
"""A task holds so many bytes of one slide at a time; a larger slide leaves several accumulators."""
TURN_BYTES = 256 << 20
"""So many bytes of search bounds are shipped to the tasks at once; more cut slides are searched in turns by ranges of slides."""
BINS = 128
P90 = 0.9
LARGEST = np.finfo(np.float64).max
MOMENTS = {"cnt": 0.0, "mean": 0.0, "m2": 0.0, "max": -np.inf, "n": 0.0, "lo": np.inf, "hi": -np.inf}
"""Of the values that are there: number, mean, squared deviations, maximum; of those that have an order: number and bounds."""
STATISTICS = ("mean", "max", "p90", "std", "top", "bottom")


def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, which components are there): null and missing components of shorter vectors are not."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return values.reshape(len(sizes), width), there.reshape(len(sizes), width)
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x, valid = np.zeros((len(sizes), width)), np.zeros((len(sizes), width), bool)
    x[row, col], valid[row, col] = values, there
    return x, valid


def stacked(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(x.shape[1] for x, _ in parts)
    wide = lambda a: a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))
    return np.concatenate([wide(x) for x, _ in parts]), np.concatenate([wide(v) for _, v in parts])


def ordered(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each column sorted, how many values it has); null and NaN stand behind them, infinities as the largest numbers."""
    ok = valid & ~np.isnan(x)
    return np.sort(np.where(ok, np.clip(x, -LARGEST, LARGEST), np.inf), axis=0), ok.sum(axis=0)


def unclipped(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) >= LARGEST, np.copysign(np.inf, v), v)


def between(lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The percentile between two neighbours of rank floor and ceil of 0.9 (n - 1)."""
    at = P90 * np.maximum(n - 1, 0)
    with np.errstate(invalid="ignore"):
        return np.where(lo == hi, lo, lo + (hi - lo) * (at - np.floor(at)))


def mean_of(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = valid.sum(axis=0)
    return np.where(valid, x, 0).sum(axis=0) / np.maximum(n, 1), n


def nullable(values: np.ndarray, there: np.ndarray) -> list:
    return pa.array(values, pa.float64(), mask=~np.asarray(there, bool)).to_pylist()


def moments(x: np.ndarray, valid: np.ndarray, values: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    mean, cnt = mean_of(x, valid)
    cols = np.arange(x.shape[1])
    with np.errstate(invalid="ignore"):
        m2 = np.where(valid, (x - mean) ** 2, 0).sum(axis=0)
    lo, hi = (np.where(n > 0, values[at, cols], none) for at, none in ((0, np.inf), (np.maximum(n - 1, 0), -np.inf)))
    return {"cnt": cnt.astype(float), "mean": mean, "m2": m2, "max": np.where(valid, x, -np.inf).max(axis=0), "n": n.astype(float), "lo": lo, "hi": hi}


def whole(x: np.ndarray, valid: np.ndarray, values: np.ndarray, n: np.ndarray, norm: np.ndarray, idx: np.ndarray, fraction: float) -> dict[str, list]:
    """p90, and means over the largest and smallest share by norm, of a slide of which these are all patches; null without values."""
    cols, at = np.arange(x.shape[1]), P90 * np.maximum(n - 1, 0)
    lo, hi = (unclipped(values[r.astype(np.int64), cols]) for r in (np.floor(at), np.ceil(at)))
    known = np.flatnonzero(~np.isnan(norm))
    k = max(int(np.floor(len(known) * fraction)), 1)
    out = {"p90": nullable(between(lo, hi, n), n > 0)}
    for name, key in (("top", -norm[known]), ("bottom", norm[known])):
        chosen = known[np.lexsort((idx[known], key))[:k]]
        mean, there = mean_of(x[chosen], valid[chosen])
        out[name] = nullable(mean, there > 0)
    return out


def merged_moments(a: dict, b: dict) -> dict[str, list]:
    """Moments of two sets of patches together, by their difference of means."""
    width = max(len(a["cnt"]), len(b["cnt"]))
    wide = lambda s: {k: np.concatenate([np.array(s[k], float), np.full(width - len(s[k]), none)]) for k, none in MOMENTS.items()}
    a, b = wide(a), wide(b)
    total = np.maximum(a["cnt"] + b["cnt"], 1)
    with np.errstate(invalid="ignore"):
        d = np.where((a["cnt"] > 0) & (b["cnt"] > 0), b["mean"] - a["mean"], 0)
        mean = np.where(a["cnt"] > 0, a["mean"] + d * b["cnt"] / total, b["mean"])
        m2 = a["m2"] + b["m2"] + d * d * a["cnt"] * b["cnt"] / total
    out = {"cnt": a["cnt"] + b["cnt"], "mean": mean, "m2": m2, "max": np.maximum(a["max"], b["max"]), "n": a["n"] + b["n"]}
    out |= {"lo": np.minimum(a["lo"], b["lo"]), "hi": np.maximum(a["hi"], b["hi"])}
    return {k: v.tolist() for k, v in out.items()}


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(slide, x, valid, norm, patch_idx) of runs of one slide, of at most about ``RUN_BYTES``."""
    now, parts, size = None, [], 0

    def leave() -> tuple:
        x, valid = stacked([p[:2] for p in parts])
        return now, x, valid, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])

    for batch in batches:
        slides = batch.column("slide_id").to_pylist()
        edges = [k for k in range(1, len(slides)) if slides[k] != slides[k - 1]]
        norms = batch.column("_norm").fill_null(float("nan")).to_numpy(zero_copy_only=False)
        idx = batch.column("patch_idx").to_numpy(zero_copy_only=False)
        for lo, hi in zip([0, *edges], [*edges, len(slides)]):
            if lo == hi:
                continue
            if parts and (slides[lo] != now or size > RUN_BYTES):
                yield leave()
                parts, size = [], 0
            x, valid = dense(batch.column("features").slice(lo, hi - lo))
            now, size = slides[lo], size + x.nbytes
            parts.append((x, valid, norms[lo:hi], idx[lo:hi]))
    if parts:
        yield leave()


def row_of(batch: pa.RecordBatch, at: int) -> dict:
    return batch.slice(at, 1).to_pylist()[0]


def fold(rows: DataFrame, merge: Callable[[dict, dict], dict]) -> DataFrame:
    """One row per slide from its accumulators, two at a time in memory: first among groups of tasks, then over all."""

    def stepped(given: DataFrame, keys: list[str]) -> DataFrame:
        schema = to_arrow_schema(given.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            for batch in batches:
                for at in range(batch.num_rows):
                    row = row_of(batch, at)
                    key = [row[k] for k in keys]
                    if held is not None and key == now:
                        held = held | merge(held, row)
                        continue
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([held], schema)
                    now, held = key, row
            if held is not None:
                yield pa.RecordBatch.from_pylist([held], schema)

        return given.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, given.schema)

    grouped = rows.withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(16)))
    return stepped(stepped(grouped, ["slide_id", "_task"]).drop("_task"), ["slide_id"])


def accumulated(normed: DataFrame, fraction: float) -> DataFrame:
    """One accumulator per slide and task: moments, and the other statistics as of a whole slide."""
    slide = normed.schema["slide_id"].dataType.simpleString()
    schema = f"slide_id {slide}, " + ", ".join(f"`{c}` array<double>" for c in (*MOMENTS, "p90", "top", "bottom"))
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slide_id, x, valid, norm, idx in runs(batches):
            values, n = ordered(x, valid)
            row = {k: v.tolist() for k, v in moments(x, valid, values, n).items()} | whole(x, valid, values, n, norm, idx, fraction)
            yield pa.RecordBatch.from_pylist([{"slide_id": slide_id, **row}], arrow)

    return normed.mapInArrow(run, schema)


def histogram(values: np.ndarray, here: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int) -> dict[str, list]:
    """Counts, smallest and largest values of the bins between ``lo`` and ``hi`` of each sorted column; bins count on from ``first``."""
    inside = here & (values >= lo) & (values <= hi)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = (values / 2 - lo / 2) / np.where(hi > lo, hi / 2 - lo / 2, 1)
    place = np.clip(np.where(inside, share, 0) * BINS, 0, BINS - 1).astype(np.int64) + np.arange(values.shape[1]) * BINS + first
    key, v = place.T[inside.T], values.T[inside.T]  # columns are sorted, so keys rise
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    ends = np.r_[starts[1:], len(key)][: len(starts)].astype(np.int64)
    return {"bin": key[starts].tolist(), "count": (ends - starts).tolist(), "low": v[starts].tolist(), "high": v[ends - 1].tolist()}


def searched(normed: DataFrame, bounds: DataFrame, with_extremes: bool) -> DataFrame:
    """(slide_id, bin, count, low, high, top, top_n, bottom, bottom_n): per slide and task, what lies between the bounds.

    ``bin`` numbers (neighbour, dimension, bin of ``BINS``); low and high are the smallest and largest value seen in it.
    """
    shipped = normed.sparkSession.sparkContext.broadcast({r["slide_id"]: r for r in bounds.toArrow().to_pylist()})
    slide = normed.schema["slide_id"].dataType.simpleString()
    schema = (
        f"slide_id {slide}, bin array<int>, count array<long>, low array<double>, high array<double>, "
        "top array<double>, top_n array<long>, bottom array<double>, bottom_n array<long>"
    )
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slide_id, x, valid, norm, idx in runs(batches):
            b = shipped.value.get(slide_id)
            if b is None:
                continue
            dims = len(b["lo"]) // 2
            wide = lambda a, none=0: np.pad(a, [(0, 0)] * (a.ndim - 1) + [(0, dims - x.shape[1])], constant_values=none)  # noqa: B023, E731
            values, n = ordered(x, valid)
            values, here = wide(values, np.inf), np.arange(len(values))[:, None] < wide(n)
            lo, hi = (np.array(b[k]).reshape(2, dims) for k in ("lo", "hi"))
            both = [histogram(values, here, lo[t], hi[t], t * dims * BINS) for t in range(2)]
            row = {"slide_id": slide_id} | {k: both[0][k] + both[1][k] for k in both[0]}
            if with_extremes:
                none = b["top_norm"] is None
                top = (norm > b["top_norm"]) | ((norm == b["top_norm"]) & (idx <= b["top_idx"])) if not none else np.zeros(len(norm), bool)
                bottom = (norm < b["bottom_norm"]) | ((norm == b["bottom_norm"]) & (idx <= b["bottom_idx"])) if not none else top
                for name, chosen in (("top", top), ("bottom", bottom)):
                    row[name] = wide(np.where(valid[chosen], x[chosen], 0).sum(axis=0)).tolist()
                    row[f"{name}_n"] = wide(valid[chosen].sum(axis=0)).tolist()
            yield pa.RecordBatch.from_pylist([row], arrow)

    return normed.mapInArrow(run, schema)


def merged_bins(a: dict, b: dict) -> dict:
    bins, at = np.unique(a["bin"] + b["bin"], return_inverse=True)
    count, low, high = np.zeros(len(bins), np.int64), np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
    np.add.at(count, at, a["count"] + b["count"])
    np.minimum.at(low, at, a["low"] + b["low"])
    np.maximum.at(high, at, a["high"] + b["high"])
    out = {"bin": bins.tolist(), "count": count.tolist(), "low": low.tolist(), "high": high.tolist()}
    if a["top"] is not None:
        out |= {k: [p + q for p, q in zip(a[k], b[k])] for k in ("top", "top_n", "bottom", "bottom_n")}
    return out


def narrowed(bounds: DataFrame, found: DataFrame) -> DataFrame:
    """The bounds after one search: those of the bin that holds the wanted rank, and the rank within it."""
    schema = bounds.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = row_of(batch, at)
                bins, count = np.array(row["bin"], np.int64), np.array(row["count"], np.int64)
                lo, hi, rank = (np.array(row[k]) for k in ("lo", "hi", "rank"))
                before = np.concatenate([[0], np.cumsum(count)])
                edges = np.searchsorted(bins, np.arange(len(lo) + 1) * BINS)
                some = np.flatnonzero(edges[1:] > edges[:-1])
                first = before[edges[:-1][some]]
                hit = np.searchsorted(before, first + rank[some], side="right") - 1
                lo[some], hi[some] = np.array(row["low"])[hit], np.array(row["high"])[hit]
                rank[some] -= before[hit] - first
                new = {"lo": lo.tolist(), "hi": hi.tolist(), "rank": rank.tolist()}
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in schema.names} | new], arrow)

    return bounds.join(found.drop("top", "top_n", "bottom", "bottom_n"), "slide_id").mapInArrow(run, schema)


def search_bounds(normed: DataFrame, merged: DataFrame, fraction: float) -> DataFrame:
    """Where both neighbours of the percentile lie at first, and the last (norm, patch_idx) of the extreme patches."""
    keys = materialise(normed.select("slide_id", "patch_idx", "_norm").join(merged.select("slide_id"), "slide_id", "left_semi"), "norms")
    size = lambda n: F.greatest(F.floor(n * F.lit(fraction)), F.lit(1))
    edge = lambda largest: extreme_rows(keys, ["slide_id"], "_norm", "patch_idx", size, largest).groupBy("slide_id")
    top = edge(True).agg(F.min("_norm").alias("top_norm"), F.max_by("patch_idx", F.struct(-F.col("_norm"), "patch_idx")).alias("top_idx"))
    bottom = edge(False).agg(F.max("_norm").alias("bottom_norm"), F.max_by("patch_idx", F.struct("_norm", "patch_idx")).alias("bottom_idx"))
    at = F.transform("n", lambda v: F.lit(P90) * F.greatest(v - 1, F.lit(0.0)))
    rank = F.concat(F.transform(at, lambda v: F.floor(v)), F.transform(at, lambda v: F.ceil(v))).alias("rank")
    start = merged.select("slide_id", F.concat("lo", "lo").alias("lo"), F.concat("hi", "hi").alias("hi"), rank)
    return materialise(start.join(top, "slide_id", "left").join(bottom, "slide_id", "left"), "bounds")


def cut_slides(normed: DataFrame, parts: DataFrame, fraction: float) -> DataFrame:
    """(slide_id, *STATISTICS) as arrays of slides whose patches several tasks hold."""
    merged = materialise(fold(parts.select("slide_id", *MOMENTS), merged_moments), "moments")
    bounds = search_bounds(normed, merged, fraction)
    per_turn = max(TURN_BYTES // (48 * max(merged.agg(F.max(F.size("cnt"))).first()[0], 1)), 1)

    def search(open_: DataFrame, with_extremes: bool) -> DataFrame:
        found = None
        for lo, hi in turns(open_.select("slide_id"), "slide_id", ["slide_id"], per_turn):
            inside = F.lit(True) if lo is None else F.col("slide_id").between(lo, hi)
            part = searched(normed.where(inside), open_.where(inside), with_extremes)
            found = part if found is None else found.unionByName(part)
        return materialise(fold(found, merged_bins), "bins")

    settled = F.forall(F.arrays_zip("lo", "hi"), lambda b: b["lo"] >= b["hi"])
    found = search(bounds, True)
    extremes, done, open_ = found.select("slide_id", "top", "top_n", "bottom", "bottom_n"), None, narrowed(bounds, found)
    while True:
        open_ = materialise(open_, "bounds")
        part = open_.where(settled).select("slide_id", F.col("lo").alias("found"))
        done = part if done is None else done.unionByName(part)
        open_ = open_.where(~settled)
        if open_.isEmpty():
            break
        open_ = narrowed(open_, search(open_, False))
    together = merged.join(done, "slide_id").join(extremes, "slide_id")
    slide = normed.schema["slide_id"].dataType.simpleString()
    schema = f"slide_id {slide}, " + ", ".join(f"`{c}` array<double>" for c in STATISTICS)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = row_of(batch, at)
                v = {k: np.array(row[k], float) for k in (*MOMENTS, "found", "top", "top_n", "bottom", "bottom_n")}
                lo, hi = unclipped(v["found"]).reshape(2, -1)
                there = v["cnt"] > 0
                out = {"slide_id": row["slide_id"], "mean": nullable(v["mean"], there), "max": nullable(v["max"], there)}
                out |= {"std": nullable(np.sqrt(v["m2"] / np.maximum(v["cnt"], 1)), there), "p90": nullable(between(lo, hi, v["n"]), v["n"] > 0)}
                for name in ("top", "bottom"):
                    out[name] = nullable(v[name] / np.maximum(v[f"{name}_n"], 1), v[f"{name}_n"] > 0)
                yield pa.RecordBatch.from_pylist([out], arrow)

    return together.mapInArrow(run, schema)


def pooling_statistics(patches: DataFrame, fraction: float = 0.10, clustered: bool = False) -> DataFrame:
    """(slide_id, dim, mean, max, p90, std, top, bottom) over the patches of each slide; p90 is exact and interpolated.

    ``top`` and ``bottom`` are means over the share of patches with the largest and smallest norm, ties by patch_idx, one patch at least. Null
    components and those that a shorter vector lacks are left out; a statistic without values is null. NaN has no place in an
    order, so p90 leaves it out, as top and bottom do with vectors whose norm is null or NaN; mean, max and std become NaN.
    Rows without slide or vector take no part. ``clustered`` states that rows come slide by slide, as the feature store writes them, and
    saves a sort inside tasks.
    """
    normed = patches.where(F.col("slide_id").isNotNull() & F.col("features").isNotNull()).select(
        "slide_id", F.col("patch_idx").cast("long").alias("patch_idx"), F.col("features").cast("array<double>").alias("features")
    ).withColumn("_norm", l2_norm(F.col("features")))
    placed = normed if clustered else normed.sortWithinPartitions("slide_id")
    parts = materialise(accumulated(placed, fraction), "accumulators")
    cut = parts.groupBy("slide_id").agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1").select("slide_id")
    none_cut = cut.isEmpty()
    cut = cut if none_cut else materialise(cut, "cut")

    def there(value):
        return F.transform(F.arrays_zip("cnt", "mean", "max", "m2"), lambda s: F.when(s["cnt"] > 0, value(s)))

    std = there(lambda s: F.sqrt(s["m2"] / s["cnt"])).alias("std")
    single = (parts if none_cut else parts.join(cut, "slide_id", "left_anti")).select(
        "slide_id", there(lambda s: s["mean"]).alias("mean"), there(lambda s: s["max"]).alias("max"), "p90", std, "top", "bottom"
    )
    wide = single if none_cut else single.unionByName(cut_slides(placed, parts.join(cut, "slide_id", "left_semi"), fraction))
    rows = wide.select("slide_id", F.posexplode(F.arrays_zip(*STATISTICS)).alias("dim", "s"))
    return rows.select("slide_id", "dim", *[F.col(f"s.{c}").alias(c) for c in STATISTICS])
