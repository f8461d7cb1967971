import json
import os

import pytest
from pyspark.sql import functions as F

from bagspark.operators import catalog as C
from bagspark.session import materialise
from bagspark.sources import landed as L
from bagspark.streaming import ingest as I
from bagspark.streaming import monitor as M


def names(spark, *files):
    return C.describe_files(spark.createDataFrame([(str(i), n, s) for i, (n, s) in enumerate(files)], "file_id string, file_name string, file_size bigint"))


def test_barcodes_and_smallest_slide(spark):
    df = names(spark, ("TCGA-AA-0001-01Z-00-DX1.abc.svs", 3_000), ("TCGA-AA-0001-01Z-00-dx2.abd.svs", 900), ("TCGA-AA-0002-01Z-00-TS1.abc.svs", 5))
    rows = {r["file_id"]: r for r in df.collect()}
    assert rows["0"]["patient_id"] == "TCGA-AA-0001" and rows["0"]["slide_barcode"] == "TCGA-AA-0001-01Z-00-DX1"
    assert [rows[i]["is_diagnostic"] for i in "012"] == [True, True, False]
    assert {r["file_id"] for r in C.one_slide_per_patient(df).collect()} == {"1", "2"}


def test_shards_are_disjoint_complete_and_even(spark):
    df = materialise(names(spark, *[(f"P-{i % 13:02d}-x-DX{i}.a.svs", i) for i in range(97)]))
    parts = [{r["file_id"] for r in C.shard(df, i, 5).collect()} for i in range(5)]
    assert sum(map(len, parts)) == 97 and len(set().union(*parts)) == 97
    assert max(map(len, parts)) - min(map(len, parts)) <= 1
    assert C.shard(df, 0, 1).count() == 97
    with pytest.raises(ValueError):
        C.shard(df, 5, 5)


def test_listing_pages_labels_and_journals(spark, folder):
    hits = [{"file_id": "b", "file_name": "Q-1-2-DX1.z.svs", "file_size": 5, "md5sum": "m"}, {"file_id": "a", "file_name": "P-1-2-DX1.z.svs"}]
    os.makedirs(f"{folder}/l")
    for i, h in enumerate(hits):
        with open(f"{folder}/l/{i}.json", "w") as f:
            json.dump({"data": {"hits": [h]}}, f, indent=2)
    out = L.read_catalog(spark, f"{folder}/l").collect()
    assert [(r["file_id"], r["file_size"], r["md5"]) for r in out] == [("a", 0, None), ("b", 5, "m")]
    with open(f"{folder}/labels.csv", "w") as f:
        f.write("who,grade\nx,2\ny,1\nx,0\n")
    votes = L.read_labels(spark, f"{folder}/labels.csv", "who", "grade").orderBy("pos").collect()
    assert [(r["patient_id"], r["label"]) for r in votes] == [("x", 2), ("y", 1), ("x", 0)]
    with open(f"{folder}/j.jsonl", "w") as f:
        f.write('{"slide_id": 1, "shard": 0, "ok": true}\n{"slide_id": 2, "sh\n{"slide_id": 3, "shard": 1, "ok": false}\n')
    assert {r["slide_id"] for r in L.read_journal(spark, f"{folder}/j.jsonl").collect()} == {1, 3}


def test_landed_files_are_verified(spark, folder):
    os.makedirs(f"{folder}/in")
    for n, body in (("a", b"abc"), ("b", b"abcd"), ("c", b"xyz")):
        with open(f"{folder}/in/{n}", "wb") as f:
            f.write(body)
    import hashlib

    good = hashlib.md5(b"abc").hexdigest()
    rows = [("a", 3, good), ("b", 3, None), ("c", 0, good), ("d", 1, None)]
    catalog = spark.createDataFrame(rows, "file_name string, file_size bigint, md5 string")
    out = {r["file_name"]: r["status"] for r in C.verify_landed_files(catalog, L.scan_landed(spark, f"{folder}/in")).collect()}
    assert out == {"a": "ok", "b": "size_mismatch", "c": "md5_mismatch", "d": "missing"}
    light = C.verify_landed_files(catalog, L.scan_landed(spark, f"{folder}/in", with_md5=False))
    assert {r["file_name"]: r["status"] for r in light.collect()}["c"] == "ok"


def test_collect_runs(spark, folder):
    for run, files in {"good": ["MANIFEST.json"], "bad": ["MANIFEST.json", "TRAINING_FAILED.txt"], "open": ["log.txt"]}.items():
        os.makedirs(f"{folder}/{run}")
        for name in files:
            with open(f"{folder}/{run}/{name}", "w") as f:
                json.dump({"encoder": "e", "cohort": {"n_usable": 7}, "cv": {"qwk": {"mean": 0.4, "std": 0.1}}}, f, indent=1)
    out = {r["run"]: (r["run_status"], r["n_usable"], r["cv_qwk_mean"]) for r in L.collect_runs(spark, folder).collect()}
    assert out == {"good": ("complete", 7, 0.4), "bad": ("failed", 7, 0.4), "open": ("incomplete", None, None)}


def test_seed_from_prior_outcomes(spark):
    def prior(*rows):
        return spark.createDataFrame(list(rows), "file_id string, pooling string")

    have = spark.createDataFrame([("a",)], "file_id string")
    out = C.seed_from_prior(have, [prior(("a", "cls"), ("b", None)), prior(("b", "cls"), ("c", "cls_mean"), ("d", "cls"))])
    assert {(r["file_id"], r["prior"], r["outcome"]) for r in out.collect()} == {
        ("a", 0, "present"), ("b", 0, "seeded"), ("b", 1, "superseded"), ("c", 1, "skipped"), ("d", 1, "seeded"),
    }


def test_ingest_is_exactly_once_across_runs(spark, folder):
    def rows(lo, hi, pooling):
        return spark.range(lo, hi).select(
            (F.col("id") % 3).alias("slide_id"), F.col("id").alias("patch_idx"), F.lit(0).cast("bigint").alias("x"),
            F.lit(0).cast("bigint").alias("y"), F.lit("e").alias("encoder"), F.lit(pooling).cast("string").alias("pooling"),
            F.array(F.lit(1.0).cast("float")).alias("features"),
        )

    src, store = f"{folder}/src", f"{folder}/store"
    rows(0, 10, "cls").write.mode("append").parquet(src)
    I.stream_ingest(spark, src, store, f"{folder}/c1").awaitTermination()
    rows(5, 20, None).write.mode("append").parquet(src)
    rows(20, 25, "cls_mean").write.mode("append").parquet(src)
    I.stream_ingest(spark, src, store, f"{folder}/c1", max_files_per_trigger=2).awaitTermination()
    I.stream_ingest(spark, src, store, f"{folder}/c1").awaitTermination()
    I.stream_ingest(spark, src, store, f"{folder}/c2").awaitTermination()
    kept = spark.read.parquet(f"{store}/accepted")
    assert sorted(r["patch_idx"] for r in kept.collect()) == list(range(20))
    assert spark.read.parquet(f"{store}/diverted").count() == 5


def journal(spark, folder, rows):
    df = spark.createDataFrame(rows, "slide_id bigint, shard bigint, ts string, ok boolean, n_patches bigint, finished boolean")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").json(f"{folder}/j")
    return spark.readStream.schema("slide_id bigint, shard bigint, ts timestamp, ok boolean, n_patches bigint, finished boolean").json(f"{folder}/j")


def test_late_rows_are_dropped(spark, folder):
    def run(rows):
        return M.drain(M.stream_journal_rates(journal(spark, folder, rows)), f"{folder}/o", f"{folder}/c")

    run([(1, 0, "2024-01-01 00:10:00", True, 3600, False), (2, 0, "2024-01-01 05:00:00", True, 1, False)])
    out = run([(3, 0, "2024-01-01 00:20:00", True, 99, False), (4, 0, "2024-01-01 09:00:00", False, 5, False)]).collect()
    got = {(r["window_start"].hour, r["done"], r["failed"], r["patches"], r["patches_per_sec"]) for r in out}
    assert got == {(0, 1, 0, 3600, 1.0), (5, 1, 0, 1, 1 / 3600)}


def test_notifications_survive_a_broken_sink(spark, folder):
    rows = [(i, i % 2, "2024-01-01 00:00:00", i % 10 != 0, 2, i >= 98) for i in range(100)]
    log = f"{folder}/log"

    def sink(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        raise RuntimeError("down")

    M.stream_notify(journal(spark, folder, rows), sink, f"{folder}/c", every=20).awaitTermination()
    lines = open(log).read().splitlines()
    assert sum("FINISHED" in t for t in lines) == 2
    assert sum(t.startswith("[shard 0] 20 done") for t in lines) == 1 and sum(t.startswith("[shard 1]") for t in lines) == 2


def test_first_vote_follows_file_order_whatever_the_file_sizes(spark, folder):
    import os

    os.makedirs(f"{folder}/votes")
    for name, rows in (("a", [("P1", 0)]), ("b", [("P1", 2)] + [(f"Q{k}", 1) for k in range(3000)])):
        with open(f"{folder}/votes/{name}.csv", "w") as f:
            f.write("patient_id,label\n" + "".join(f"{p},{x}\n" for p, x in rows))
    from bagspark.operators.splits import majority_label

    votes = L.read_labels(spark, f"{folder}/votes")
    assert majority_label(votes).where("patient_id = 'P1'").first()["label"] == 0
    order = [r["patient_id"] for r in votes.orderBy("pos").collect()]
    assert order == ["P1", "P1", *[f"Q{k}" for k in range(3000)]]


def test_keys_with_both_poolings_in_one_batch_lose_nothing(spark, folder):
    from pyspark.sql import functions as F

    from bagspark.streaming.ingest import stream_ingest

    keys = spark.range(200).select((F.col("id") % 7).alias("slide_id"), F.col("id").alias("patch_idx"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit("e").alias("encoder"))
    vector = F.array(F.lit(1.0).cast("float")).alias("features")
    rows = [keys.select("*", F.lit(p).cast("string").alias("pooling"), vector) for p in ("cls_mean", "cls", None)]
    rows[0].unionByName(rows[1]).unionByName(rows[2]).coalesce(1).write.parquet(f"{folder}/in")
    for checkpoint in ("c1", "c2"):
        stream_ingest(spark, f"{folder}/in", f"{folder}/store", f"{folder}/{checkpoint}").awaitTermination()
    for part in ("accepted", "diverted"):
        out = spark.read.parquet(f"{folder}/store/{part}")
        assert out.count() == out.select("slide_id", "patch_idx").distinct().count() == 200


def test_heartbeats_are_read_and_broken_ones_counted(spark, folder):
    import json
    import os

    os.makedirs(f"{folder}/beats")
    for k in range(3):
        with open(f"{folder}/beats/shard{k}.json", "w") as f:
            f.write(json.dumps({"shard": k, "status": "running", "done": 5 * k, "extra": 1}, indent=2) if k else '{"shard": 9,\n')
    beats, unreadable = L.read_heartbeats(spark, f"{folder}/beats")
    assert sorted((r["shard"], r["done"], r["file_name"]) for r in beats.collect()) == [(1, 5, "shard1.json"), (2, 10, "shard2.json")]
    assert unreadable.first()[0] == 1


def test_query_lands_both_poolings_in_parallel(spark, monkeypatch):
    """The second arrival is not pulled through one task; the result stays that of one batch with both poolings."""
    from bagspark.queries import streams

    landed, ingest = [], streams.I.stream_ingest
    monkeypatch.setattr(streams.I, "stream_ingest", lambda spark, src, *a: landed.append(set(os.listdir(src))) or ingest(spark, src, *a))
    out = streams.stream_ingest(spark, "/root/testdata/sf0.001").groupBy("pooling", "outcome").count().collect()
    assert len([f for f in landed[1] - landed[0] if f.endswith(".parquet")]) > 1
    assert sorted((r.pooling, r.outcome) for r in out) == [("cls", "accepted"), ("cls_mean", "diverted")]
