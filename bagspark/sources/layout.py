"""A feature table in buckets, and joins that leave its vectors where they are.

Rows are bucketed by slide and by stretches of patch_idx, so a slide of any size is spread over buckets, and whatever is to be
joined is sent to them: weights, crops, labels and priorities move, vectors do not. The moving side is hashed per bucket, so
vectors are not sorted either.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["slide_id", "stretch"]


@dataclass(frozen=True)
class Layout:
    """``buckets`` of a table and how many consecutive patch_idx of a slide stay in one."""

    buckets: int = 256
    stretch: int = 65_536

    def stretch_of(self, patch_idx: str = "patch_idx") -> Column:
        return F.floor(F.col(patch_idx) / F.lit(self.stretch)).cast("bigint")

    def sent(self, rows: DataFrame) -> DataFrame:
        """``rows`` dealt to the buckets."""
        return rows.repartition(self.buckets, *KEY).hint("shuffle_hash")


def write_bucketed(df: DataFrame, table: str, layout: Layout = Layout(), path: str | None = None, mode: str = "overwrite") -> None:
    """Writes patches as the table ``table``, one sorted file per bucket; ``path`` keeps the files outside the warehouse."""
    placed = df.withColumn("stretch", layout.stretch_of()).repartition(layout.buckets, *KEY).sortWithinPartitions(*KEY, "patch_idx")
    writer = placed.write.mode(mode).bucketBy(layout.buckets, *KEY).sortBy(*KEY, "patch_idx").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The table, for the joins below. Tells the session that a join may rely on buckets by some of its keys, or Spark would move the vectors
    to deal them by (slide, stretch, patch)."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(table)


def beside_patches(patches: DataFrame, rows: DataFrame, layout: Layout | None, how: str = "inner") -> DataFrame:
    """``patches`` with the columns of ``rows``, keyed by (slide_id, patch_idx)."""
    if layout is None:
        return patches.join(rows, ["slide_id", "patch_idx"], how)
    return patches.join(layout.sent(rows.withColumn("stretch", layout.stretch_of())), [*KEY, "patch_idx"], how)


def beside_slides(patches: DataFrame, rows: DataFrame, layout: Layout) -> DataFrame:
    """``patches`` of the slides in ``rows`` (one row per slide) with its columns, sent once per stretch that a slide has."""
    stretches = patches.select(*KEY).distinct()
    return patches.join(layout.sent(stretches.join(rows, "slide_id")), KEY)


def moved(df: DataFrame) -> list[Sequence[str]]:
    """The columns of everything that the plan of ``df`` exchanges, for checks that vectors stay."""
    found: list[list[str]] = []

    def walk(node) -> None:
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if "Exchange" in node.nodeName():
            out = node.output()
            found.append([out.apply(k).name() for k in range(out.size())])
        kids = node.children()
        for k in range(kids.size()):
            walk(kids.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found
