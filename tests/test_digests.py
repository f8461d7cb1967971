"""Checksums in blocks."""

import hashlib
import os

import pytest

from bagspark.sources import digests as D
from bagspark.sources.landed import scan_landed


def test_files_of_any_size_and_name_have_a_checksum(spark, folder, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    contents = {"a.svs": b"", "b b.svs": b"x" * 10, "c#1%.svs": bytes(range(256)) * 5, "sub/d.svs": b"\n\r" * 9}
    for name, data in contents.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    expected = sorted((os.path.basename(n), len(d), hashlib.md5(d).hexdigest()) for n, d in contents.items() if d)
    for limit in (0, 10, 10**9):
        assert sorted(tuple(r) for r in scan_landed(spark, folder, largest_value=limit).collect()) == expected
    assert {r["md5"] for r in scan_landed(spark, folder, with_md5=False).collect()} == {None}


def test_a_missing_file_is_an_error_and_no_file_is_none(spark, folder):
    with pytest.raises(Exception, match="absent"):
        D.file_digests(spark, [f"file:{folder}/absent"]).collect()
    assert D.file_digests(spark, []).collect() == []


def test_one_file_per_task(spark, folder):
    for k in range(3):
        with open(f"{folder}/{k}", "wb") as f:
            f.write(b"z" * k)
    df = D.file_digests(spark, [f"{folder}/{k}" for k in range(3)])
    assert df.rdd.getNumPartitions() == 3 and sorted(r["length"] for r in df.collect()) == [0, 1, 2]
