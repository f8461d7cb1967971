"""Mixing sources to target weights along a curriculum whose weights vary with training time.

Every source has a weight schedule over training time [0, 1]: w(t) = begin + (end - begin) * t. Its integral, scaled to
the source's target, is the cumulative demand for its words; inverting it turns a place in the source's
word stream into a training time. Documents are sorted by these times over ranges.

All sums are built from pieces: a source's stream is cut into 4096 pieces by hash, each piece is summed
within itself, and one small table of piece sums shifts it. So a source with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bagspark.session import materialise

SPLIT = r"[\x20\x09-\x0D]+"
MAX_PASSES = 3


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")).cast("long")


def targets(sizes: DataFrame, weight: Column, passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    A source gets level * weight words but at most ``passes`` times its size. The common level is found in one
    sorted sweep: with sources by rising passes * size / weight, the first one that its own level does not
    overfill settles it for the rest.
    """
    ranked = sizes.withColumn("weight", weight.cast("double"))
    cap = F.col("source_size") * passes
    by_fill = W.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everyone = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    swept = ranked.withColumn("_full", F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn(
        "_open", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ).withColumn("_level", (F.sum("source_size").over(everyone) - F.col("_full")) / F.col("_open"))
    settles = F.col("_level") * F.col("weight") <= cap
    level = swept.withColumn("_at", F.min(F.when(settles, F.struct(cap / F.col("weight"), "_level"))).over(everyone)["_level"])
    target = F.least(cap.cast("double"), F.col("_at") * F.col("weight"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def cyclic_weight(order: Column, values: tuple[int, ...] = (1, 2, 3)) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(order, F.lit(len(values))) + 1).cast("int"))


def training_time(share: Column, begin: Column, end: Column) -> Column:
    """The time at which ``share`` of a source's demand is met: the inverse of the integrated schedule."""
    slope, total = end - begin, (begin + end) / 2
    curved = (F.sqrt(begin * begin + 2 * slope * total * share) - begin) / F.when(slope == 0, F.lit(1.0)).otherwise(slope)
    return F.when(slope == 0, share).otherwise(curved)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
    carry: tuple[str, ...] = (), seed: int = 0,
) -> DataFrame:
    """The training order: one row per pass over a document, sorted by ``position`` in [0, 1].

    Columns: doc_id, source, row_id (number of the row within its source: rows that repeat a doc_id, or have none, stay
    apart), size (words; 0 for null text), source_size, target, pass_no, position, words (taken in
    this pass; the last pass of a source stops in the middle of a document when its target is met, so a source's
    words add up to its rounded target), carried columns. A document of which nothing is taken has one row with
    pass_no 0, no position and no words.

    Sources in order of their code points, null last, weigh ``weights`` in turn. Within a source documents
    follow a hash of doc_id, rows of equal doc_id their size and text, so reruns agree. Source weights start
    at weight and move towards the mean of all weights over training.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("_h"),
        F.xxhash64(F.col(text)).alias("_t"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    ).withColumn("_piece", F.substring("_h", 1, 3)).withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    pieces = materialise(rows.groupBy("_key", "source", "_piece").agg(F.sum("size").alias("_sum")), "pieces")
    sizes = pieces.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    order = sizes.withColumn("_order", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    goals = targets(order, cyclic_weight(F.col("_order"), weights))
    middle = sum(weights) / len(weights)
    along = W.partitionBy("_key").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0))).select("_key", "_piece", "_before")
    own = goals.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    goals = materialise(starts.join(own, "_key").select("_key", "_piece", "_before", "source_size", "weight", "target"), "goals")
    within = W.partitionBy("_key", "_piece").orderBy("_h", "size", "_t")
    nth = F.conv("_piece", 16, 10).cast("long") * (1 << 40) + F.row_number().over(within)
    summed = rows.withColumn("_in", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("row_id", nth)
    found = summed.join(goals, ["_key", "_piece"])
    start = F.col("_before") + F.col("_in")
    asked = F.floor(F.col("target") + 0.5).cast("long")
    placed = found.withColumn("_start", start).withColumn("_asked", asked)
    stream = F.col("_start") + F.col("source_size") * (F.col("pass_no") - 1)
    taken = F.least(F.col("size"), F.col("_asked") - stream)
    wanted = F.filter(F.sequence(F.lit(1), F.lit(MAX_PASSES)), lambda k: (F.col("size") > 0) & (F.col("_start") + F.col("source_size") * (k - 1) < F.col("_asked")))
    out = placed.withColumn("pass_no", F.explode(F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit(0)))))
    share = F.least(F.lit(1.0), stream / F.col("_asked"))
    position = training_time(share, F.col("weight"), F.lit(float(middle)))
    return out.select(
        "doc_id", "source", "row_id", "size", "source_size", "target", "pass_no",
        F.when(F.col("pass_no") > 0, position).alias("position"), F.when(F.col("pass_no") > 0, taken).otherwise(F.lit(0)).cast("long").alias("words"),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id", "pass_no")


def training_passes(docs: DataFrame, **given) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, row_id, size, source_size, target, taken, passes.

    ``passes`` has (position, pass_no, words) of each pass over the row, in training order; ``taken`` adds up their
    words. Arguments are those of ``mix``, whose sorted order is written out and reduced here.
    """
    order = materialise(mix(docs, **given), "order")
    own = ("source", "row_id", "doc_id", "size", "source_size", "target")
    placed = F.when(F.col("position").isNotNull(), F.struct("position", "pass_no", "words"))
    rows = order.groupBy(*own).agg(F.sort_array(F.collect_list(placed)).alias("passes"))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return rows.select("doc_id", "source", "row_id", "size", "source_size", "target", taken.alias("taken"), "passes")
