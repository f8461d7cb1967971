import glob
import gzip
import hashlib
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bagspark.llm.warc import read_archive, write_archive, write_warc

BIG = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" * 40
PAGES = "page_id long, url string, html string, record_type string, payload string, sha256 string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


ROWS = [(1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (3, None, BIG), (4, "http://c", "small"), (5, "http://d", "small"), (6, "u", None), (7, "v", ""),
        (8, "w", "y" * 999), (9, "w", "y" * 999), (10, "z", "z" * 1000), (11, "z", "z" * 1000), (11, "z", "z" * 1000), (None, "n", "z" * 1000), (None, "m", "n" * 2000)]


def plain(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        revisit = len(data) >= 1000 and bool(same) and i != max(same)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None, data))
    return sorted(out, key=str)


def test_records_come_back_from_the_archive(spark, folder):
    write_archive(pages(spark, ROWS), f"{folder}/a")
    out = read_archive(spark, f"{folder}/a")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in out.collect()), key=str)
    assert got == plain(ROWS)
    assert spark.read.parquet(f"{folder}/a/payloads").count() == len({h or "" for _, _, h in ROWS})
    assert {r.url for r in out.where("page_id = 2").collect()} == {"http://bX:y"}


def test_payload_bytes_are_not_moved_for_narrow_columns(spark, folder):
    write_archive(pages(spark, ROWS), f"{folder}/a")
    plan = read_archive(spark, f"{folder}/a").select("page_id", "payload_bytes")._jdf.queryExecution().optimizedPlan().toString()
    assert "payload#" not in plan.split("Join")[0]


def test_a_changed_payload_is_an_error(spark, folder):
    write_archive(pages(spark, ROWS[:4]), f"{folder}/a")
    stored = spark.read.parquet(f"{folder}/a/payloads")
    spark.read.parquet(f"{folder}/a/headers").write.parquet(f"{folder}/b/headers")
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{folder}/b/payloads")
    with pytest.raises(PySparkException, match="differs from its digest"):
        read_archive(spark, f"{folder}/b").collect()


def test_files_are_warc(spark, folder):
    write_archive(pages(spark, ROWS), f"{folder}/a")
    write_warc(spark, f"{folder}/a", f"{folder}/w")
    found = []
    for f in glob.glob(f"{folder}/w/*.gz"):
        data = gzip.open(f).read()
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            kind, page = re.search(rb"WARC-Type: (\w+)", head)[1].decode(), re.search(rb"WARC-Record-ID: <urn:page:([^>]*)>", head)[1].decode()
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            found.append((None if page == "none" else int(page), kind, rest[:size]))
            data = rest[size + 4 :]
    assert sorted(found, key=str) == sorted(((i, k, b"" if k == "revisit" else d) for i, _, _, k, _, d in plain(ROWS)), key=str)


def test_empty_table(spark, folder):
    write_archive(pages(spark, []), f"{folder}/a")
    assert read_archive(spark, f"{folder}/a").collect() == []
