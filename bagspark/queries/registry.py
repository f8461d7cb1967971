"""The name -> (Spark callable, SQL text) registry and the logical input tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE_TABLES = ("orders", "customer", "lineitem", "part", "events", "embeddings")

# Logical tables over the given parquet tables. The texts run unchanged in Spark and DuckDB
# unless SPARK_LOGICAL says otherwise. Most are plain projections, the others aggregate first.
LOGICAL: dict[str, str] = {
    "catalog": """
        SELECT CAST(o_orderkey AS STRING) AS file_id,
               concat('TCGA-', lpad(CAST(o_custkey % 97 AS STRING), 2, '0'), '-',
                      lpad(CAST(o_custkey AS STRING), 6, '0'), '-01Z-00-',
                      CASE WHEN o_orderstatus = 'F' THEN 'TS' ELSE 'DX' END,
                      CAST(1 + o_orderkey % 3 AS STRING), '.',
                      substr(md5(CAST(o_orderkey AS STRING)), 1, 8), '.svs') AS file_name,
               CAST(floor(o_totalprice * 10000) AS BIGINT) AS file_size,
               md5(concat('m', CAST(o_orderkey AS STRING))) AS md5sum,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'PROJ-B' ELSE 'PROJ-A' END AS project_id,
               'SVS' AS data_format,
               CASE WHEN o_orderstatus = 'F' THEN 'Tissue Slide' ELSE 'Diagnostic Slide' END
                 AS experimental_strategy,
               o_orderstatus AS status, o_orderpriority AS priority
        FROM orders""",
    "raw_labels": """
        SELECT concat('TCGA-', lpad(CAST(o_custkey % 97 AS STRING), 2, '0'), '-',
                      lpad(CAST(o_custkey AS STRING), 6, '0')) AS patient_id,
               CAST(substr(o_orderpriority, 1, 1) AS INT) % 3 AS label,
               o_orderkey AS pos
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "partly_labelled": """
        SELECT concat('TCGA-', lpad(CAST(o_custkey % 97 AS STRING), 2, '0'), '-',
                      lpad(CAST(o_custkey AS STRING), 6, '0')) AS patient_id,
               CAST(substr(o_orderpriority, 1, 1) AS INT) % 3 AS label,
               o_orderkey AS pos
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment <> 'MACHINERY'""",
    "patches": """
        SELECT l_suppkey AS slide_id,
               ((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576) * 64 + CAST(l_quantity AS BIGINT) AS patch_idx,
               (l_partkey % 24) * 448 AS x, (l_orderkey % 32) * 448 AS y,
               l_extendedprice / 15000 AS score
        FROM lineitem""",
    "map_scores": """
        SELECT l_suppkey AS slide_id,
               ((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576) * 64 + CAST(l_quantity AS BIGINT) AS patch_idx,
               unnest([0, 1, 2, 3]) AS k,
               unnest([l_extendedprice / 15000, l_quantity / 10, l_discount * 40, l_tax * 40]) AS score
        FROM lineitem""",
    "patches_vec": """
        SELECT vec_id % 20 AS slide_id, CAST(floor(vec_id / 20) AS BIGINT) AS patch_idx,
               (vec_id % 20) % 3 AS label, embedding AS features
        FROM embeddings""",
    "tokens": """
        SELECT CAST(floor(vec_id / 5) AS BIGINT) AS tile_id, vec_id % 5 AS token,
               embedding AS features
        FROM embeddings""",
    "predictions": """
        SELECT o_orderkey AS id, o_orderkey % 5 AS fold,
               CAST(substr(o_orderpriority, 1, 1) AS INT) % 3 AS y_true,
               CASE WHEN o_orderkey % 3 = 0 THEN (CAST(substr(o_orderpriority, 1, 1) AS INT) + 1) % 3
                    WHEN o_orderkey % 7 = 0 THEN (CAST(substr(o_orderpriority, 1, 1) AS INT) + 2) % 3
                    ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) % 3 END AS y_pred,
               CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 250 - 2 AS z0,
               CAST((o_orderkey * 104729) % 1000 AS DOUBLE) / 250 - 2 AS z1
        FROM orders""",
    "history": """
        SELECT run, 0 AS fold, metric,
               CAST(row_number() OVER (PARTITION BY run ORDER BY slot) AS INT) AS epoch
        FROM (SELECT user_id AS run, dayofyear(ts) * 2 + CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END AS slot,
                     avg(value) / 500 AS metric
              FROM events GROUP BY user_id, dayofyear(ts) * 2 + CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END) h""",
    "journal": """
        SELECT event_id AS slide_id, user_id % 4 AS shard, ts, event_type <> 'error' AS ok,
               CAST(floor(value * 40) AS BIGINT) AS n_patches,
               value / 3 AS encode_seconds, value / 30 AS grid_seconds, value / 300 AS write_seconds
        FROM events""",
    "trials": """
        SELECT l_suppkey AS study,
               CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS BIGINT) AS trial,
               l_linenumber AS step, avg(l_extendedprice) / 100000 AS score
        FROM lineitem
        GROUP BY l_suppkey, (year(l_shipdate) - 1995) * 12 + month(l_shipdate), l_linenumber""",
    "geometry": """
        SELECT p_partkey AS slide_id, 2000 + 80 * p_size AS w0,
               CAST(1500 + 60 * (p_partkey % 50) AS INT) AS h0,
               CASE p_type WHEN 'SMALL' THEN '0.25' WHEN 'LARGE' THEN '0.5' WHEN 'PROMO' THEN 'n/a'
                           WHEN 'MEDIUM' THEN '0' ELSE NULL END AS mpp_prop,
               CASE p_type WHEN 'ECONOMY' THEN 'centimeter' WHEN 'PROMO' THEN 'inch' ELSE NULL END AS tiff_unit,
               CASE p_type WHEN 'ECONOMY' THEN '40000' WHEN 'PROMO' THEN '50800' ELSE NULL END AS tiff_xres
        FROM part""",
    "pixels": """
        SELECT l_suppkey AS slide_id, CAST(l_orderkey % 25 AS INT) AS y, CAST(l_partkey % 24 AS INT) AS x,
               CAST(max(60 + (l_partkey * 7) % 196) AS INT) AS r,
               CAST(min(40 + (l_orderkey * 13) % 200) AS INT) AS g,
               CAST(max(60 + (l_partkey + l_linenumber * 31) % 190) AS INT) AS b
        FROM lineitem GROUP BY l_suppkey, l_orderkey % 25, l_partkey % 24""",
}

# The same table where the engines spell unnesting differently.
SPARK_LOGICAL: dict[str, str] = {
    "map_scores": """
        SELECT l_suppkey AS slide_id,
               ((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576) * 64 + CAST(l_quantity AS BIGINT) AS patch_idx,
               stack(4, 0, l_extendedprice / 15000, 1, l_quantity / 10,
                        2, l_discount * 40, 3, l_tax * 40) AS (k, score)
        FROM lineitem""",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame | tuple[DataFrame, ...]:
    """Logical tables (or given ones) as DataFrames."""
    out = []
    for name in names:
        if name in LOGICAL:
            text = SPARK_LOGICAL.get(name, LOGICAL[name])
            used = [t for t in BASE_TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)]
            for t in used:
                text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
            out.append(spark.sql(text, **frames))
        else:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out[0] if len(out) == 1 else tuple(out)


def with_tables(names: str, body: str) -> str:
    """``WITH`` clause of logical tables in front of an oracle query."""
    ctes = ",\n".join(f"{n} AS ({LOGICAL[n]})" for n in names.split())
    body = body.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, inputs: str = "") -> Callable[[Query], Query]:
    """Register a callable, with its SQL restatement over the named logical tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(inputs, sql) if inputs else sql.strip()
        return fn

    return register


def r6(column: Column | str) -> Column:
    """Six decimals, without negative zero; the SQL side writes round(x, 6) + 0.0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small named file through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
