"""A content-addressed WARC archive: payload bytes once per strong digest, exact record headers beside them.

``write_archive`` writes two tables. ``headers`` has one row per record with its header block exactly as it stands in
the file; ``payloads`` has each distinct payload once under its SHA-256. ``read_archive`` joins them back and
checks every stored payload against its digest. ``write_warc`` writes plain WARC/1.1 files from the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_FROM = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header_block(date: str) -> Column:
    """The header of one record, each line ended by CRLF, without the empty line that follows."""
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_sha1"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")), F.lit(f"{CRLF}WARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes ``pages`` as an archive under ``path``. Null html: empty payload; null url: no target line.

    Of records with equal payloads of at least 1000 bytes, the one with the largest page_id is the response
    and the others are revisits of it; rows that repeat that page_id are responses too, rows without page_id are
    revisits of it. Where no row of such a payload has a page_id, and for smaller payloads, all are responses.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("sha256", F.sha2("payload", 256))
    sized = keyed.select("page_id", "url", "sha256", F.sha1("payload").alias("payload_sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    holders = sized.groupBy(F.col("sha256").alias("_k"), "payload_bytes").agg(F.max("page_id").alias("_holder")).where(
        (F.col("payload_bytes") >= REVISIT_FROM) & F.col("_holder").isNotNull()
    ).select("_k", "_holder")
    typed = sized.join(holders, F.col("sha256") == F.col("_k"), "left")
    revisit = F.col("_holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_holder"))
    records = typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_holder")))
    records.select("page_id", "sha256", header_block(date).alias("header")).write.mode("errorifexists").parquet(f"{path}/headers")
    # equal digests mean equal bytes, so any copy will do; copies within a task collapse before the shuffle
    keyed.groupBy("sha256").agg(F.first("payload").alias("payload")).write.mode("errorifexists").parquet(f"{path}/payloads")


def field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?dm)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(found != "", found)


def page_of(uri: Column) -> Column:
    number = F.regexp_extract(uri, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(number != "", number).cast("long")


def stored_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload, payload_bytes, payload_digest) of the archive; a payload that differs from its digest is an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("sha256")
    checked = F.when(sound, F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "sha256")))
    return stored.select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, its fields parsed from the stored header and its full payload joined by digest.

    Columns: page_id, url, record_type, refers_to, header, payload, payload_bytes, payload_digest (SHA-1, hex).
    Revisits carry the payload of the record they refer to. Columns that are not selected are not moved.
    """
    headers = spark.read.parquet(f"{path}/headers").select(
        "sha256", "header", page_of(field("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"),
        page_of(field("WARC-Refers-To")).alias("refers_to"), field("WARC-Payload-Digest").alias("_declared"),
    )
    joined = headers.join(stored_payloads(spark, path), "sha256")
    agreed = F.col("_declared") == F.concat(F.lit("sha1:"), "payload_digest")
    digest = F.when(agreed, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload disagree")))
    return joined.withColumn("payload_digest", digest).drop("_declared", "sha256")


def write_warc(spark: SparkSession, path: str, to: str, compression: str = "gzip") -> None:
    """The archive as WARC/1.1 files under ``to``: header, empty line, block, two line ends per record."""
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    records = read_archive(spark, path).select(F.concat("header", F.lit(CRLF), block).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", compression).text(to)
