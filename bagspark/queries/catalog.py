"""Catalogue queries over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.operators import catalog as C
from bagspark.operators.splits import majority_label
from bagspark.queries.registry import query, r6, rounded, tables, write_file
from bagspark.queries.splits import MAJORITY
from bagspark.session import materialise, scratch_path
from bagspark.sources import landed as L

DESCRIBED = """described AS (
  SELECT *, md5sum AS md5,
         array_to_string(list_slice(string_split(file_name, '-'), 1, 3), '-') AS patient_id,
         string_split(file_name, '.')[1] AS slide_barcode,
         contains(upper(string_split(file_name, '.')[1]), '-DX') AS is_diagnostic
  FROM catalog)"""
FILE_COLS = ["file_id", "file_name", "file_size", "md5", "patient_id", "slide_barcode", "is_diagnostic"]
FILES = ", ".join(FILE_COLS)


def catalog(spark, sf):
    return C.describe_files(tables(spark, sf, "catalog").withColumn("md5", F.col("md5sum")))


@query("read_catalog", f"WITH {DESCRIBED} SELECT {FILES} FROM described", "catalog")
def read_catalog(spark, sf):
    rows = tables(spark, sf, "catalog")
    hit = F.struct("file_id", "file_name", "file_size", "md5sum", "project_id", "data_format", "experimental_strategy")
    pages = rows.groupBy(F.floor(F.col("file_id").cast("bigint") / 5000).alias("page")).agg(
        F.struct(F.collect_list(hit).alias("hits")).alias("data")
    )
    path = scratch_path(spark, "listing")
    pages.select("data").write.json(path)
    return L.read_catalog(spark, path, multi_line=False).select(*FILE_COLS)


@query("read_labels", "SELECT patient_id, label, pos FROM raw_labels", "raw_labels")
def read_labels(spark, sf):
    path = scratch_path(spark, "labels")
    tables(spark, sf, "raw_labels").write.csv(path, header=True)
    return L.read_labels(spark, path, pos_col="pos")


@query("read_labels_files", f"WITH {MAJORITY} SELECT * FROM labelled", "raw_labels")
def read_labels_files(spark, sf):
    """Votes of one folder of files without a position column: rows count in file order."""
    path = scratch_path(spark, "labels")
    tables(spark, sf, "raw_labels").repartitionByRange(7, "pos").sortWithinPartitions("pos").drop("pos").write.csv(path, header=True)
    return majority_label(L.read_labels(spark, path))


@query(
    "read_heartbeats",
    """SELECT shard, count(*) FILTER (WHERE ok) AS done, count(*) FILTER (WHERE NOT ok) AS failed, CAST(1 AS BIGINT) AS n_unreadable FROM journal GROUP BY shard""",
    "journal",
)
def read_heartbeats(spark, sf):
    """One indented document per shard and one that breaks off."""
    path = scratch_path(spark, "heartbeats")
    shards = tables(spark, sf, "journal").groupBy("shard").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    text = F.to_json(F.struct("shard", "done", "failed"), {"pretty": "true"})
    broken = shards.agg(F.max("shard").alias("shard")).select(F.lit('{"shard": 1,\n "done"').alias("value"), F.lit(-1).cast("bigint").alias("part"))
    documents = shards.select(text.alias("value"), F.col("shard").alias("part")).unionByName(broken)
    documents.write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    beats, unreadable = L.read_heartbeats(spark, path)
    return beats.select("shard", "done", "failed", F.lit(1).alias("_one")).join(unreadable.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query(
    "read_journal",
    """SELECT slide_id, shard, ok, n_patches, round(encode_seconds, 6) + 0.0 AS encode_seconds
       FROM journal WHERE ok OR n_patches < 10000""",
    "journal",
)
def read_journal(spark, sf):
    rows = tables(spark, sf, "journal")
    text = F.to_json(F.struct(*rows.columns))
    broken = ~F.col("ok") & (F.col("n_patches") >= 10000)
    path = scratch_path(spark, "journal")
    rows.select(F.when(broken, F.substring(text, 1, 25)).otherwise(text)).write.text(path)
    return L.read_journal(spark, path).select(
        "slide_id", "shard", "ok", "n_patches", r6("encode_seconds").alias("encode_seconds")
    )


@query(
    "verify_landed_files",
    """WITH landed AS (
         SELECT file_id, CASE WHEN priority = '5-LOW' THEN file_size + 1 ELSE file_size END AS length,
                CASE WHEN priority = '4-NOT SPECIFIED' THEN md5(md5sum) ELSE md5sum END AS md5
         FROM catalog WHERE status <> 'P')
       SELECT c.file_id, CASE WHEN l.file_id IS NULL THEN 'missing'
                              WHEN c.file_size <> 0 AND l.length <> c.file_size THEN 'size_mismatch'
                              WHEN l.md5 <> c.md5sum THEN 'md5_mismatch' ELSE 'ok' END AS status
       FROM catalog c LEFT JOIN landed l ON c.file_id = l.file_id""",
    "catalog",
)
def verify_landed_files(spark, sf):
    rows = tables(spark, sf, "catalog")
    arrived = rows.where("status <> 'P'").select(
        "file_id",
        (F.col("file_size") + F.when(F.col("priority") == "5-LOW", 1).otherwise(0)).alias("length"),
        F.when(F.col("priority") == "4-NOT SPECIFIED", F.md5("md5sum")).otherwise(F.col("md5sum")).alias("md5"),
    )
    listed = rows.select("file_id", "file_size", F.col("md5sum").alias("md5"))
    return C.verify_landed_files(listed, arrived, key="file_id").select("file_id", "status")


@query(
    "extraction_report",
    """WITH s AS (SELECT CASE WHEN NOT ok THEN 'failed' WHEN encode_seconds < 10 THEN 'cached' ELSE 'done' END AS status,
                         n_patches, CASE WHEN NOT ok THEN 'unreadable' END AS error FROM journal)
       SELECT coalesce(status, 'total') AS status, count(*) AS slides,
              CAST(coalesce(sum(CASE WHEN status = 'done' THEN n_patches END), 0) AS BIGINT) AS patches,
              count(error) AS errors
       FROM s GROUP BY status
       UNION ALL
       SELECT 'total', count(*), CAST(sum(CASE WHEN status = 'done' THEN n_patches END) AS BIGINT), count(error) FROM s""",
    "journal",
)
def extraction_report(spark, sf):
    rows = tables(spark, sf, "journal")
    status = F.when(~F.col("ok"), "failed").when(F.col("encode_seconds") < 10, "cached").otherwise("done")
    return C.extraction_report(
        rows.select(status.alias("status"), "n_patches", F.when(~F.col("ok"), "unreadable").alias("error"))
    )


@query("parse_barcode", f"WITH {DESCRIBED} SELECT file_id, patient_id, slide_barcode FROM described", "catalog")
def parse_barcode(spark, sf):
    return C.parse_barcode(tables(spark, sf, "catalog")).select("file_id", "patient_id", "slide_barcode")


@query("is_diagnostic", f"WITH {DESCRIBED} SELECT file_id, is_diagnostic FROM described", "catalog")
def is_diagnostic(spark, sf):
    return catalog(spark, sf).select("file_id", "is_diagnostic")


@query(
    "filter_catalog",
    f"""WITH {DESCRIBED} SELECT {FILES} FROM described
        WHERE project_id = 'PROJ-A' AND data_format = 'SVS'
          AND experimental_strategy = 'Diagnostic Slide' AND is_diagnostic""",
    "catalog",
)
def filter_catalog(spark, sf):
    rows = tables(spark, sf, "catalog").withColumn("md5", F.col("md5sum"))
    return C.filter_catalog(rows, project="PROJ-A").select(*FILE_COLS)


@query(
    "restrict_to_labelled",
    f"""WITH {DESCRIBED} SELECT file_id, patient_id FROM described
        WHERE patient_id IN (SELECT patient_id FROM partly_labelled)""",
    "catalog partly_labelled",
)
def restrict_to_labelled(spark, sf):
    labels = majority_label(tables(spark, sf, "partly_labelled"))
    return C.restrict_to_labelled(catalog(spark, sf), labels).select("file_id", "patient_id")


@query(
    "pending_slides",
    "SELECT file_id FROM catalog WHERE file_id NOT IN (SELECT file_id FROM catalog WHERE status = 'F')",
    "catalog",
)
def pending_slides(spark, sf):
    rows = tables(spark, sf, "catalog")
    return C.pending_slides(rows, rows.where("status = 'F'")).select("file_id")


@query(
    "seed_from_prior",
    """WITH offers AS (
         SELECT file_id, 0 AS prior, 'cls' AS pooling FROM catalog WHERE priority = '1-URGENT'
         UNION ALL SELECT file_id, 1, 'cls' FROM catalog WHERE priority IN ('1-URGENT', '2-HIGH')
         UNION ALL SELECT file_id, 2, 'cls_mean' FROM catalog WHERE priority IN ('2-HIGH', '3-MEDIUM')),
       store AS (SELECT file_id FROM catalog WHERE status = 'P')
       SELECT o.file_id, o.prior, o.pooling,
              CASE WHEN EXISTS (SELECT 1 FROM store s WHERE s.file_id = o.file_id) THEN 'present'
                   WHEN o.pooling <> 'cls' THEN 'skipped'
                   WHEN NOT EXISTS (SELECT 1 FROM offers p WHERE p.file_id = o.file_id AND p.prior < o.prior
                                    AND p.pooling = 'cls') THEN 'seeded' ELSE 'superseded' END AS outcome
       FROM offers o""",
    "catalog",
)
def seed_from_prior(spark, sf):
    rows = tables(spark, sf, "catalog")
    unmarked = rows.where("priority = '1-URGENT'").select("file_id", F.lit(None).cast("string").alias("pooling"))
    second = rows.where("priority IN ('1-URGENT', '2-HIGH')").select("file_id", F.lit("cls").alias("pooling"))
    wide = rows.where("priority IN ('2-HIGH', '3-MEDIUM')").select("file_id", F.lit("cls_mean").alias("pooling"))
    return C.seed_from_prior(rows.where("status = 'P'"), [unmarked, second, wide])


@query(
    "catalog_summary",
    f"""WITH {DESCRIBED} SELECT count(*) AS slides, count(DISTINCT patient_id) AS patients,
        round(sum(file_size) / 1e9, 6) + 0.0 AS total_gb, round(sum(file_size) / 1e9 / count(*), 6) + 0.0 AS mean_gb
        FROM described""",
    "catalog",
)
def catalog_summary(spark, sf):
    return rounded(C.catalog_summary(catalog(spark, sf)), "total_gb", "mean_gb")


ONE = f"""WITH {DESCRIBED}, one AS (
  SELECT * FROM described QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY file_size, file_name) = 1)"""


@query("one_slide_per_patient", f"{ONE} SELECT patient_id, file_id, file_name, file_size FROM one", "catalog")
def one_slide_per_patient(spark, sf):
    return C.one_slide_per_patient(catalog(spark, sf)).select("patient_id", "file_id", "file_name", "file_size")


@query(
    "shard",
    f"""WITH {DESCRIBED} SELECT file_id, patient_id, file_name FROM described
        QUALIFY (row_number() OVER (ORDER BY patient_id, file_name, file_id) - 1) % 5 = 2""",
    "catalog",
)
def shard(spark, sf):
    rows = catalog(spark, sf).select("file_id", "patient_id", "file_name")
    return C.shard(rows, 2, 5)


@query(
    "limit_slides",
    f"{ONE} SELECT patient_id, file_name FROM one ORDER BY patient_id, file_name LIMIT 200",
    "catalog",
)
def limit_slides(spark, sf):
    return C.limit_slides(C.one_slide_per_patient(catalog(spark, sf)), 200).select("patient_id", "file_name")


@query(
    "plan_budget",
    f"""{ONE}, tot AS (SELECT count(*) AS slides, sum(file_size) / 1e9 AS total_gb, count(*) * 8000 AS patches FROM one),
        acc(accelerator, tflops) AS (VALUES ('tpu-v5e-8', 540.0e0), ('tpu-v3-8', 140.0e0), ('gpu-t4x2', 55.0e0),
                                            ('gpu-p100', 12.0e0), ('gpu-a100', 180.0e0)),
        cost AS (SELECT *, total_gb * 1000 / 143.0e0 / 3600 AS download_h, patches / 216.0e0 / 3600 AS decode_h,
                        patches * 540.0e0 * 1e9 / (tflops * 1e12) / 3600 AS encode_h FROM tot, acc),
        fin AS (SELECT *, greatest(download_h, encode_h + decode_h) * 1.15e0 AS total_h,
                       CAST(floor(download_h / (540.0e0 * 1e9 / (tflops * 1e12) / 3600 + 1 / 216.0e0 / 3600) / slides / 100) * 100
                            AS BIGINT) AS free_cap FROM cost)
        SELECT accelerator, slides, round(download_h, 6) + 0.0 AS download_h, round(decode_h, 6) + 0.0 AS decode_h,
               round(encode_h, 6) + 0.0 AS encode_h, round(total_h, 6) + 0.0 AS total_h,
               round(total_h / 4, 6) + 0.0 AS per_shard_h, round(patches * 1536 * 2 / 1e9, 6) + 0.0 AS storage_gb,
               free_cap, CASE WHEN free_cap <= 8000 THEN 'compute-bound' ELSE 'raise cap' END AS verdict
        FROM fin""",
    "catalog",
)
def plan_budget(spark, sf):
    df = C.plan_budget(C.one_slide_per_patient(catalog(spark, sf)))
    hours = ["download_h", "decode_h", "encode_h", "total_h", "per_shard_h", "storage_gb"]
    return rounded(df, *hours).select("accelerator", "slides", *hours, F.col("free_cap").cast("bigint").alias("free_cap"), "verdict")


LANDED = """held AS (SELECT c_nationkey AS n, concat('nation', CAST(c_nationkey AS STRING), '.svs') AS file_name,
    concat(CAST(count(*) AS STRING), '|', CAST(min(c_custkey) AS STRING), '|', CAST(max(c_custkey) AS STRING)) AS text FROM {} GROUP BY c_nationkey)"""


@query(
    "landed_files",
    f"""WITH {LANDED.format('customer')}
        SELECT file_name, CASE WHEN n % 5 <> 3 THEN CAST(strlen(text) AS BIGINT) END AS length, CASE WHEN n % 5 <> 3 THEN md5(text) END AS found_md5,
               CASE n % 5 WHEN 3 THEN 'missing' WHEN 1 THEN 'size_mismatch' WHEN 2 THEN 'md5_mismatch' ELSE 'ok' END AS status FROM held""",
)
def landed_files(spark, sf):
    """Lands one file per nation but some, scans them, small ones as values and others in blocks, and holds them against a catalogue."""
    customers = tables(spark, sf, "customer")
    held = materialise(spark.sql(f"WITH {LANDED.format('{customer}')} SELECT * FROM held", customer=customers), "held")
    root = scratch_path(spark, "landed")
    for row in held.where("n % 5 <> 3").collect():  # one short row per nation
        write_file(spark, f"{root}/{row['n'] % 3}/{row['file_name']}", row["text"])
    odd = F.col("n") % 5
    catalog = held.select(
        "file_name", F.when(odd == 1, F.length("text") + 1).when(odd == 4, 0).otherwise(F.length("text")).cast("long").alias("file_size"),
        F.when(odd == 2, F.md5(F.lit("other"))).when(odd == 4, F.lit(None)).otherwise(F.md5("text")).alias("md5"),
    )
    landed = L.scan_landed(spark, root, largest_value=held.agg(F.percentile_approx(F.length("text"), 0.5)).first()[0])
    checked = C.verify_landed_files(catalog, landed)
    return checked.join(landed.select("file_name", "length", F.col("md5").alias("found_md5")), "file_name", "left").select("file_name", "length", "found_md5", "status")
