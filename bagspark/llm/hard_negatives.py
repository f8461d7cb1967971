"""Exact hard-negative mining over shared candidate lists of anchor clusters.

Anchors are clustered by direction. A task holds one shard of the rows; for each anchor cluster it sorts the shard
once by what the score of any member can reach at most: for a member within angle ``b`` of the centroid and a row at
angle ``t`` from it, the score is at most |anchor| * |row| * cos(max(0, t - b)). All members walk that one list, block by
block, and each stops for good once the bound of the next row is below the last score it still needs. What a shard finds is
at most a few rows per anchor, and a window over these makes the global choice; no pair is sent otherwise.

Rows are dealt to shards by a hash and anchors, one row in a hundred, are sent to each shard. A shard is a fixed number of
bytes; anchors stream past it one cluster at a time, so a task holds a shard and at most ``CLUSTER_ROWS`` anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bagspark.session import materialise

SCALE = 256
SHARD_BYTES = 32 << 20
BLOCK = 512
CLUSTER_ROWS = 512
CENTROIDS = 256
SAMPLE = 4096
FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def usable(rows: DataFrame, vec_id: str, vec: str, label: Column) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, one per vec_id: that with the smallest label, then vector."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec).alias("vec"))
    kept = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(finite)
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of a list column, within 2^53; shorter vectors are filled up with zeros."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.clip(np.floor(SCALE * np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)), -(2.0**53), 2.0**53)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one and their former lengths; a zero row stays zero."""
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def cluster_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started from rows spread evenly over the sample."""
    x, _ = directions(x)
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        empty = np.abs(sums).sum(axis=1) == 0
        centres = np.where(empty[:, None], centres, directions(sums)[0])
    return centres


def best(row: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each row, by falling score and rising id."""
    order = np.lexsort((other, -score, row))
    starts = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


class Shard:
    """Rows of one shard, ready to be listed for one anchor cluster after the other."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.unit, self.norm = directions(x)

    def scores(self, anchors: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact integer inner products: in floating point where no partial sum can be rounded."""
        reach = float(np.sqrt((anchors**2).sum(axis=1)).max(initial=0) * self.norm[at].max(initial=0))
        kind = np.float32 if reach < 2**23 else np.float64 if reach < 2**52 else np.int64
        return (anchors.astype(kind) @ self.x[at].astype(kind).T).astype(np.int64)

    def listed(self, unit: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, bound): the shard by falling bound on the score of a member of length one."""
        angle = lambda c: np.arccos(np.clip(c, -1, 1))
        zero = ~unit.any(axis=1)
        widest = np.where(zero, np.pi, angle(unit @ centre)).max()
        bound = self.norm * np.cos(np.maximum(0, angle(self.unit @ centre) - widest - 1e-7))
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def walk(self, x: np.ndarray, queries: np.ndarray, fits, floor: np.ndarray, k: int, centre: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, row, score): the first ``k`` fitting rows of each query.

        ``queries`` is the member each query belongs to, ``fits(query, rows, scores)`` marks what it may take and no score under
        ``floor`` counts. A query leaves the walk when the next bound is below ``floor`` and its k-th score.
        """
        unit, norm = directions(x)
        order, bound = self.listed(unit, centre)
        need = floor.astype(np.float64)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        alive = np.arange(len(queries))
        for lo in range(0, len(order), BLOCK):
            top = norm[queries[alive]] * bound[lo]
            alive = alive[top + 1e-6 * np.abs(top) + 1e-3 >= need[alive]]
            if not len(alive):
                break
            at = order[lo : lo + BLOCK]
            members, back = np.unique(queries[alive], return_inverse=True)
            scores = self.scores(x[members], at)[back]
            q, j = np.nonzero(fits(alive, at, scores) & (scores >= need[alive][:, None]))
            if not len(q):
                continue
            query = np.r_[held[0], alive[q]]
            row, score = np.r_[held[1], at[j]], np.r_[held[2], scores[q, j]]
            keep = best(query, score, self.ids[row], k)
            held = query[keep], row[keep], score[keep]
            full = np.bincount(held[0], minlength=len(queries)) == k
            last = np.full(len(queries), np.inf)
            np.minimum.at(last, held[0], held[2])
            need = np.where(full, np.maximum(need, last), need)
        return held


def mined(shards: DataFrame, width: int, centres: np.ndarray, k: int, low: int, high: int, negatives: bool) -> DataFrame:
    """What each shard finds for the anchors that stream past it: positives, or negatives of every given positive.

    ``shards`` is dealt by shard and sorted by (shard, cluster); cluster -1 marks the rows of the shard itself.
    """

    def search(shard: Shard, centre: np.ndarray, members: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = (np.concatenate([m[c] for m in members]) for c in range(3))
        if negatives:
            given = [(m, p["id"], p["score"]) for m, ps in enumerate(ps for member in members for ps in member[3]) for p in ps]
            member, pid, ps = np.array(given, np.int64).reshape(-1, 3).T
            floor = -((-low * ps) // 100)
        else:
            member, pid, ps = np.arange(len(ids)), np.full(len(ids), -1), np.zeros(len(ids), np.int64)
            floor = np.full(len(ids), np.iinfo(np.int64).min)

        def fits(q: np.ndarray, at: np.ndarray, s: np.ndarray) -> np.ndarray:
            same = shard.labels[at][None, :] == labels[member[q]][:, None]
            if not negatives:
                return same & (shard.ids[at][None, :] != ids[q][:, None])
            return ~same & (100 * s >= low * ps[q][:, None]) & (100 * s <= high * ps[q][:, None])

        q, row, score = shard.walk(x, member, fits, floor, k, centre)
        columns = (ids[member[q]], pid[q], ps[q], shard.ids[row], score)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["anchor_id", "positive_id", "positive_score", "found_id", "score"])

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        """((shard, cluster), ids, labels, x, positives) of at most ``CLUSTER_ROWS`` rows of one key each."""
        keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "cluster")], axis=1)
        edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
        for lo, hi in zip(edges[:-1], edges[1:]):
            for at in range(lo, hi, CLUSTER_ROWS):
                piece = batch.slice(at, min(CLUSTER_ROWS, hi - at))
                ids, labels = (piece.column(c).to_numpy() for c in ("vec_id", "label"))
                yield tuple(keys[lo].tolist()), ids, labels, matrix(piece.column("vec"), width), piece.column("positives").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stored, shard, waiting = (None, None), [], None, []
        for batch in batches:
            for key, ids, labels, x, positives in pieces(batch):
                if waiting and (key != place or sum(len(w[0]) for w in waiting) + len(ids) > CLUSTER_ROWS):
                    yield from search(shard, centres[place[1]], waiting)
                    waiting = []
                if key[0] != place[0]:
                    stored, shard = [], None
                if key[1] < 0:
                    stored.append((ids, labels, x))
                elif shard is None and stored:
                    shard, stored = Shard(*(np.concatenate(v) for v in zip(*stored))), []
                if key[1] >= 0 and shard is not None:
                    waiting.append((ids, labels, x, positives))
                place = key
        if waiting:
            yield from search(shard, centres[place[1]], waiting)

    return shards.mapInArrow(run, FOUND)


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows per key over all shards, ranked from 1; each shard sent ``k`` at most."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    vec_id: str = "vec_id", vec: str = "embedding", label: str | Column = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    Scores are inner products of floor(256 * x). Anchors are rows whose vec_id is divisible by ``anchor_every``; their positives
    are the best other rows of their label, and the negatives of a positive the best rows of another label whose score is
    from ``low`` to ``high`` percent of the positive's. Ties go to the smaller vec_id. Results are exact: every row is searched.

    Rows without vec_id, label or vector and rows with a null or non-finite component take no part; of rows that repeat a
    vec_id one takes part, that with the smallest label, then vector. Missing components at the end of a vector count as 0, and
    an empty vector has score 0 with all. Components are limited to 2^53 after scaling; scores from 2^52 on are 64-bit
    integers that wrap. An anchor without positives, a positive without negatives and an empty table give no rows. Other
    columns are ignored. The centroids are fitted on at most ``SAMPLE`` anchors; they only decide how soon lists end.
    """
    spark = rows.sparkSession
    given = materialise(usable(rows, vec_id, vec, F.col(label) if isinstance(label, str) else label), "vectors")
    is_anchor = F.col("vec_id") % anchor_every == 0
    n, width, n_anchors = given.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.count_if(is_anchor)).first()
    width = max(width, 1)
    per_shard = max(SHARD_BYTES // (8 * width), 1)
    n_shards = max(-(-n // per_shard), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    sample = given.where(is_anchor).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column(0)
    # the sample is at most SAMPLE rows and the centres CENTROIDS, whatever the number of anchors
    k = max(min(CENTROIDS, -(-n_anchors // 128), len(sample)), 1)
    centres = cluster_centres(matrix(sample.combine_chunks(), width), k) if len(sample) else np.zeros((1, width))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.argmax(directions(matrix(batch.column("vec"), width))[0] @ centres.T, axis=1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32))], [*batch.schema.names, "cluster"])

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    anchors = given.where(is_anchor).mapInArrow(nearest, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", cluster int")
    anchors = materialise(anchors, "anchors")
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    items = given.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(-1).alias("cluster"), "vec_id", "label", "vec", none.alias("positives"))

    def passed(asked: DataFrame, k: int, second: bool) -> DataFrame:
        sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "cluster", "vec_id", "label", "vec", "positives")
        dealt = items.unionByName(sent).repartition(n_shards, "shard").sortWithinPartitions("shard", "cluster")
        return mined(dealt, width, centres, k, low, high, second)

    near = first_of(passed(anchors.withColumn("positives", none), positives, False), ["anchor_id"], positives)
    known = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("found_id").alias("id"), "score")).alias("positives"))
    asked = anchors.join(materialise(known, "positives").withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    hard = first_of(passed(asked, negatives, True), ["anchor_id", "positive_id"], negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
