"""Grouped primitives that stay balanced when one group holds a large share of all rows.

None of them puts a whole hot group into one task. Group statistics are aggregates with map-side
combine; they are written and travel back to rows through :func:`attach_stats`, which splits the
hot groups. Building a frame may therefore run small jobs.
Ranks come from bucket counts (hash order) or from sampled ranges (value order).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bagspark.session import materialise

HOT_ROWS = 2_000_000
"""Largest number of rows of one group that a single task is asked to handle."""


def attach_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    n_col: str = "n",
    hot_rows: int = HOT_ROWS,
    written: bool = False,
) -> DataFrame:
    """Inner-join one statistics row per group onto the rows of that group.

    ``stats`` carries the group size in ``n_col``. It is written first (unless ``written`` says it
    already is): the aggregation then runs once, and Spark picks a broadcast or a shuffled join
    from the real size of the table. When some group has more than ``hot_rows`` rows, it is cut
    into ``ceil(n / hot_rows)`` pieces by a hash of ``spread`` and its statistics row is repeated
    once per piece. The table of hot groups has at most total_rows / hot_rows entries; Spark knows its
    size and decides how to join it.
    """
    keys = list(keys)
    if not written:
        stats = materialise(stats, "stats")
    hot = stats.where(F.col(n_col) > hot_rows)
    kept = stats.drop(n_col) if n_col in rows.columns else stats
    if hot.isEmpty():
        return rows.join(kept, keys)
    pieces = F.ceil(F.col(n_col) / F.lit(float(hot_rows))).cast("int")
    salted_rows = rows.join(hot.select(*keys, pieces.alias("_pieces")), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("_pieces").cast("bigint")).cast("int")
        ),
    ).drop("_pieces")
    salts = F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)).alias("_salt")
    return salted_rows.join(stats.select(*kept.columns, salts), [*keys, "_salt"]).drop("_salt")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group: one partially aggregated pass over the key columns."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return int(row["n"] or 0)


def smallest_by_hash(
    df: DataFrame, keys: Sequence[str], u: str, cap: int, tie: Sequence[str]
) -> DataFrame:
    """The ``cap`` rows of each group with the smallest ``u`` (uniform in [0, 1)).

    Rows are first binned by the exponent of ``u``: at most 33 counts per group say from which
    exponent on a row can still matter, so about twice ``cap`` rows per group reach the shuffle
    and the ranking window, however big the group is. Exact for every distribution of ``u``.
    """
    keys = list(keys)
    exponent = F.when(F.col(u) <= 0, F.lit(32)).otherwise(
        F.least(F.floor(-F.log2(F.col(u))).cast("int"), F.lit(32))
    )
    binned = df.withColumn("_e", exponent)
    counts = binned.groupBy(*keys, "_e").agg(F.count(F.lit(1)).alias("_c"))
    below = W.partitionBy(*keys).orderBy(F.desc("_e")).rowsBetween(W.unboundedPreceding, 0)
    cut = (
        counts.withColumn("_cum", F.sum("_c").over(below))
        .groupBy(*keys)
        .agg(
            F.coalesce(F.max(F.when(F.col("_cum") >= cap, F.col("_e"))), F.lit(0)).alias("_cut"),
            F.sum("_c").alias("_n"),
        )
    )
    near = attach_stats(binned, cut, keys, tie, n_col="_n").where(F.col("_e") >= F.col("_cut"))
    order = W.partitionBy(*keys).orderBy(u, *tie)
    return (
        near.withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= cap)
        .drop("_rn", "_e", "_cut", "_n")
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    u: str,
    tie: Sequence[str],
    out: str = "position",
    buckets: int = 4096,
) -> DataFrame:
    """0-based position of every row of a group in the order of ``u`` (uniform in [0, 1)).

    ``u`` is uniform, so equal-width buckets are balanced: ranking happens inside
    (group, bucket) and the bucket counts supply the offset.
    """
    keys = list(keys)
    bucketed = df.withColumn("_b", F.floor(F.col(u) * buckets).cast("int"))
    counts = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset")
    )
    local = W.partitionBy(*keys, "_b").orderBy(u, *tie)
    ranked = bucketed.withColumn("_rn", F.row_number().over(local) - 1)
    return (
        ranked.join(offsets, [*keys, "_b"])
        .withColumn(out, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .drop("_b", "_rn", "_offset")
    )


def ranged_prefix(
    df: DataFrame,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    weight: str | None = None,
    out: str = "before",
) -> DataFrame:
    """Sum of ``weight`` (or the number) of the rows ahead of each row in its group.

    The frame is range-partitioned on (keys, order), which cuts big groups at value boundaries,
    and written once, because sampled bounds may differ when recomputed. Each (partition, group)
    piece then needs one offset; the pieces number partitions + groups. ``order`` must be total.
    """
    keys = list(keys)
    sort = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33).cast("int"))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = materialise(ranged.drop("_id"), "ranged")
    if weight is None:
        stored = stored.withColumn("_local", F.col("_row")).withColumn("_w", F.lit(1))
    else:
        ahead = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
        stored = stored.withColumn("_w", F.col(weight)).withColumn(
            "_local", F.coalesce(F.sum("_w").over(ahead), F.lit(0))
        )
    pieces = stored.groupBy("_part", *keys).agg(
        F.min("_local").alias("_first"), F.sum("_w").alias("_total")
    )
    earlier = (
        W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = pieces.select(
        "_part",
        *keys,
        (F.coalesce(F.sum("_total").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    return (
        stored.join(offsets, ["_part", *keys])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_part", "_row", "_local", "_w", "_offset")
    )


def turns(rows: DataFrame, key: str, order: Sequence[str], at_once: int) -> list[tuple]:
    """(lowest, highest) key of each turn, for work that can take about ``at_once`` rows at a time; a key is in one turn.

    ``order`` starts with the key and is total. One turn without bounds, ``(None, None)``, if all rows fit.
    """
    if rows.count() <= at_once:
        return [(None, None)]
    placed = ranged_prefix(rows, order).groupBy(key).agg(F.min("before").alias("before"))
    bounds = placed.groupBy(F.expr(f"before div {at_once}").alias("turn")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return [(r["lo"], r["hi"]) for r in bounds.orderBy("turn").collect()]


Rank = Callable[[Column], Column]


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Rank],
    bins: int = 1024,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact order statistics per group: ``keys, n, <one column per rank>``.

    ``ranks`` maps an output name to a 1-based ascending rank computed from the group size. Nulls and NaN are left out.
    When no group exceeds ``hot_rows`` a ranking window does it in one shuffle. Otherwise the
    value range of each group is binned twice, each time counting with map-side combine and
    keeping only the bin that holds the wanted rank, so that little of a hot group is shuffled.
    The located bins, a few rows per group, are written between the passes over the rows.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    n = F.col("n")
    clamp = {k: F.least(F.greatest(r(n).cast("bigint"), F.lit(1)), n) for k, r in ranks.items()}
    if largest_group(base, keys) <= hot_rows:
        w = W.partitionBy(*keys)
        ranked = base.select(
            *keys,
            "_v",
            F.row_number().over(w.orderBy("_v")).alias("_rn"),
            F.count(F.lit(1)).over(w).alias("n"),
        )
        picks = [F.max(F.when(F.col("_rn") == r, F.col("_v"))).alias(k) for k, r in clamp.items()]
        return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)

    spread = ["_v"]
    size = F.count(F.lit(1))
    sizes = materialise(
        base.groupBy(*keys).agg(size.alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes"
    )
    wanted = sizes.select(
        *keys,
        "n",
        F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.alias("rank")) for k, r in clamp.items()])).alias("_t"),
    ).select(*keys, "n", F.col("_t.name").alias("_name"), F.col("_t.rank").alias("_rank"))

    def bin_of(lo: str, hi: str) -> Column:
        span = F.col(hi) - F.col(lo)
        scaled = F.floor((F.col("_v") - F.col(lo)) / F.when(span > 0, span).otherwise(F.lit(1.0)) * bins)
        return F.least(scaled, F.lit(bins - 1)).cast("int")

    def locate(hist: DataFrame, targets: DataFrame, group: list[str], order: str) -> DataFrame:
        """The histogram entry of each target, its rank made relative to that entry."""
        ahead = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        cum = hist.withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
        hit = (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_c"))
        return (
            targets.join(cum, group)
            .where(hit)
            .withColumn("_rank", F.col("_rank") - F.col("_before"))
            .drop("_before")
        )

    entry = [size.alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first = attach_stats(base, sizes, keys, spread, hot_rows=hot_rows, written=True).withColumn("_b1", bin_of("_lo", "_hi")).drop("_lo", "_hi", "n")
    hit1 = materialise(locate(first.groupBy(*keys, "_b1").agg(*entry), wanted, keys, "_b1"), "hits")

    open1 = hit1.where(F.col("_lo") < F.col("_hi"))
    bounds1 = open1.groupBy(*keys, "_b1").agg(
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.max("_c").alias("_n1")
    )
    second = attach_stats(first, bounds1, [*keys, "_b1"], spread, n_col="_n1", hot_rows=hot_rows)
    second = second.withColumn("_b2", bin_of("_lo", "_hi")).drop("_lo", "_hi", "_n1")
    group2 = [*keys, "_b1"]
    hit2 = materialise(
        locate(second.groupBy(*group2, "_b2").agg(*entry), open1.drop("_c", "_lo", "_hi"), group2, "_b2"), "hits"
    )

    open2 = hit2.where(F.col("_lo") < F.col("_hi"))
    group3 = [*group2, "_b2"]
    bounds2 = open2.groupBy(*group3).agg(F.max("_c").alias("_n2"))
    third = attach_stats(second, bounds2, group3, spread, n_col="_n2", hot_rows=hot_rows)
    distinct_values = third.groupBy(*group3, "_v").agg(*entry)
    hit3 = locate(distinct_values, open2.drop("_c", "_lo", "_hi"), group3, "_v")

    answer = [*keys, "n", "_name", F.col("_lo").alias("_value")]
    answers = (
        hit1.where(F.col("_lo") == F.col("_hi")).select(*answer)
        .unionByName(hit2.where(F.col("_lo") == F.col("_hi")).select(*answer))
        .unionByName(hit3.select(*answer))
    )
    picks = [F.max(F.when(F.col("_name") == k, F.col("_value"))).alias(k) for k in ranks]
    return answers.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact linearly interpolated percentiles per group: ``keys, n, <names>``."""
    ranks: dict[str, Rank] = {}
    for name, p in ps.items():
        ranks[f"_{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1
        ranks[f"_{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p)) + 1
    stats = order_statistics(df, keys, value, ranks, hot_rows=hot_rows)
    for name, p in ps.items():
        pos = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        stats = stats.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return stats.select(*keys, "n", *ps)


def global_percentile(df: DataFrame, value: str, p: float, out: str) -> DataFrame:
    """One-row exact percentile over a whole column."""
    return percentiles(df.select(F.lit(0).alias("_g"), value), ["_g"], value, {out: p}).drop("_g")


def extreme_rows(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    size: Rank,
    largest: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The ``size(n)`` rows of each group with the largest (smallest) value, ties by ``tie``.

    Rows without a value (null or NaN) are neither counted nor returned, at any group size.

    With a group above ``hot_rows`` the boundary value is selected first, and only the rows that
    are equal to it are ranked, over sampled ranges.
    """
    keys = list(keys)
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    direction = F.desc if largest else F.asc
    if largest_group(df, keys) <= hot_rows:
        w = W.partitionBy(*keys)
        ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(direction(value), tie))).withColumn(
            "_k", size(F.count(F.lit(1)).over(w))
        )
        return ranked.where(F.col("_rn") <= F.col("_k")).drop("_rn", "_k")
    rank = (lambda n: n - size(n) + 1) if largest else size
    bound = materialise(order_statistics(df, keys, value, {"_bound": rank}, hot_rows=hot_rows), "bounds")
    near = attach_stats(df, bound, keys, [value, tie], hot_rows=hot_rows, written=True)
    better = near.where(F.col(value) > F.col("_bound") if largest else F.col(value) < F.col("_bound"))
    taken = better.groupBy(*keys).agg(F.count(F.lit(1)).alias("_taken"))
    left = (size(F.col("n")) - F.coalesce("_taken", F.lit(0))).alias("_room")
    room = materialise(bound.join(taken, keys, "left").select(*keys, "n", left), "room")
    equal = near.where(F.col(value) == F.col("_bound")).drop("_bound", "n")
    placed = ranged_prefix(equal, [tie], keys=keys, out="_p")
    kept = attach_stats(placed, room, keys, [tie], hot_rows=hot_rows, written=True).where(F.col("_p") < F.col("_room"))
    return better.select(*df.columns).unionByName(kept.select(*df.columns))
