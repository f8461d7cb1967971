"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

One pass over whole texts turns each into a short vector of statistics, which is written; all that follows works
on these. Random Fourier features approximate a Gaussian kernel over the standardised statistics. Tasks emit sums
(first of the statistics, then of the normal equations), which are merged in two steps, so the driver sees about the
square root of the number of tasks. Raw scores are binned on a fixed grid, and pool-adjacent-violators over
the bins' label counts gives the calibration. All labelled rows are used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.llm.words import mix, run_hashes, runs, slices
from bagspark.session import materialise

FEATURES = 256
RIDGE = 1e-3
BINS = 2000
RANGE = (-0.5, 1.5)
STATISTICS = (
    "log_words", "word_bytes", "symbols", "exclamations", "capitals", "digits", "punctuation", "line_breaks", "distinct_words",
    "doubled_words", "repeated_runs", "non_ascii", "pipes", "long_words",
)
RUN = 4


def _kind(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOL, _SHOUT, _PIPE, _BREAK = _kind("#*$%&<>@^~_{}[]\\+="), _kind("!"), _kind("|"), _kind("\n")
_UPPER, _LOWER, _DIGIT, _POINT = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("abcdefghijklmnopqrstuvwxyz"), _kind("0123456789"), _kind(".,;:?'\"()-/")
_HIGH = np.arange(256) >= 0x80


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds]).astype(float)


def repeats(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Keys per text that repeat an earlier key of the same text."""
    own = np.sort(mix(keys + mix(text.astype(np.uint64) + np.uint64(1))))
    # the text is lost in the mixed key, so count distinct keys through their first owners
    order = np.argsort(mix(keys + mix(text.astype(np.uint64) + np.uint64(1))), kind="stable")
    again = np.zeros(len(keys), bool)
    again[1:] = own[1:] == own[:-1]
    return np.bincount(text[order], again, minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per whole text; ratios of nothing are 0."""
    out = []
    for _, _, words in slices(texts):
        n, size = words.counts.astype(float), np.diff(words.texts).astype(float)
        h, owner = words.hashes(), words.owner()
        share = lambda flags, of: per_text(flags[words.data], words.texts) / np.maximum(of, 1)
        letters = per_text((_UPPER | _LOWER)[words.data], words.texts)
        doubled = np.zeros(len(h), bool)
        doubled[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        start, text = runs(h, words.first, RUN)
        length = words.ends - words.starts
        count = lambda flags: np.bincount(owner, flags, minlength=len(n))
        out.append(np.stack([
            np.log1p(n), count(length) / np.maximum(n, 1), share(_SYMBOL, size), share(_SHOUT, size), share(_UPPER, letters), share(_DIGIT, size),
            share(_POINT, size), share(_BREAK, size), 1 - repeats(h, owner, len(n)) / np.maximum(n, 1), count(doubled) / np.maximum(n, 1),
            repeats(run_hashes(h, start, RUN), text, len(n)) / np.maximum(n, 1), share(_HIGH, size), share(_PIPE, size), count(length > 20) / np.maximum(n, 1),
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) for every row; null text counts as empty."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            flat = statistics(batch.column(1)).ravel()
            stats = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    return rows.mapInArrow(run, "doc_id long, stats array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def summed(rows: DataFrame, kernel) -> np.ndarray | None:
    """The sum of ``kernel(batch)`` (an array) over all batches: per task, then per group of tasks, then here."""

    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = kernel(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["sums"])

    def join(_, table):
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(part, "sums binary").withColumn("pid", F.spark_partition_id())
    ways = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    merged = parts.groupBy(F.pmod("pid", F.lit(ways)).alias("way")).applyInArrow(join, "sums binary").collect()
    return sum(np.frombuffer(r["sums"], np.float64) for r in merged) if merged else None


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated: the level of the raw score's bin, sloped very slightly so that higher raw scores rank higher."""
        raw = self.raw(stats)
        tilt = 1 / (1 + np.exp(-4 * (raw - 0.5)))
        return np.clip(0.999 * self.levels[bins(raw)] + 0.001 * tilt, 0, 1)


def bins(raw: np.ndarray) -> np.ndarray:
    low, high = RANGE
    return np.clip(((raw - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rising share of good labels per bin: neighbours out of order are pooled; bins without rows take the line between."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(n):
        pools.append([float(good[i]), float(n[i]), i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, m, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + m, pools[-1][2], last]
    at = [x for p in pools for x in (p[2], p[3])]
    level = [p[0] / p[1] for p in pools for _ in (0, 1)]
    return np.interp(np.arange(len(n)), at, level) if at else np.full(len(n), 0.5)


def fit(labelled: DataFrame, seed: int = 11) -> Model | None:
    """A model from rows (doc_id, stats, label 0/1): four fifths by id fit the ridge, the rest calibrate. None without rows."""
    d = len(STATISTICS)
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    rows = labelled.where("label is not null").select("stats", F.col("label").cast("double").alias("label"), calibrates.alias("calibrates"))
    moments = summed(rows, lambda b: (lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))(matrix(b.column(0))))
    if moments is None:
        return None
    mean = moments[1 : d + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[d + 1 :] / moments[0] - mean * mean, 1e-12))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale < 1e-6, 1.0, scale), rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), None, None)
    size = FEATURES + 1

    def equations(batch):
        use = ~batch.column(2).to_numpy(zero_copy_only=False)
        x, y = model.features(matrix(batch.column(0))[use]), batch.column(1).to_numpy()[use]
        return np.concatenate([(x.T @ x).ravel(), x.T @ y, [len(y)]])

    sums = summed(rows, equations)
    gram, right, n = sums[: size * size].reshape(size, size), sums[size * size : -1], max(sums[-1], 1)
    model.weights = np.linalg.solve(gram / n + RIDGE / FEATURES * np.eye(size), right / n)

    def histogram(batch):
        use = batch.column(2).to_numpy(zero_copy_only=False)
        at, y = bins(model.raw(matrix(batch.column(0))[use])), batch.column(1).to_numpy()[use]
        return np.concatenate([np.bincount(at, y, minlength=BINS), np.bincount(at, minlength=BINS)])

    found = summed(rows, histogram)
    model.levels = isotonic(found[:BINS], found[BINS:])
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): the calibrated probability of label 1; 0.5 without a model."""
    sent = stats.sparkSession.sparkContext.broadcast(model)  # a few hundred thousand numbers

    def run(batches):
        for batch in batches:
            m = sent.value
            value = m.scores(matrix(batch.column(1))) if m else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold, F.lit(False))


def learnt(stats: DataFrame, labels: DataFrame, doc_id: str, label: str) -> Model | None:
    named = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("label"))
    return fit(stats.where(~held_out()).join(named, "doc_id"))


def accepted(docs: DataFrame, labels: DataFrame, at_least: float, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` with a score of ``at_least``, all columns as they are.

    Learns like ``quality_scores``. Texts are scored where they lie, so no text is shuffled; rows that repeat and
    rows without doc_id are judged each. Without labels every row scores 0.5.
    """
    model = learnt(materialise(measured(docs, doc_id, text), "statistics"), labels, doc_id, label)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred thousand numbers
    at = docs.columns.index(text)

    def run(batches):
        m = sent.value
        for batch in batches:
            good = (m.scores(statistics(batch.column(at))) if m else np.full(batch.num_rows, 0.5)) >= at_least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1).

    Learns from labelled rows outside the held-out fifth, and from texts only. A text with several labels counts once
    per label; null labels and labels of unknown documents are ignored. Null and empty texts are scored
    like any other. Rows with a null doc_id are scored, never learnt from. Without labels all scores are 0.5.
    """
    stats = materialise(measured(docs, doc_id, text), "statistics")
    return score(stats, learnt(stats, labels, doc_id, label)).select("doc_id", held_out().alias("held_out"), "score")
