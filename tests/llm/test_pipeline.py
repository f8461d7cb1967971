import pytest

import corpus_pipeline
from bagspark.session import materialise
from tests.llm.helpers import frame, words
from tests.llm.test_decontamination import plain as found_items
from tests.llm.test_jaccard_join import plain as plain_components
from tests.llm.test_substring_dedup import plain as plain_dedup

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (None, "a b", None, None, 3)], docs.schema)
    at = docs.unionByName(extra)
    out = [at]
    for name, stage in corpus_pipeline.STAGES:
        at = materialise(stage(spark, at, DATA), name)
        out.append(at)
    return [[r.asDict() for r in df.collect()] for df in out]


def texts(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_quality_keeps_labelled_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    assert all(i in kept for i, q in labels.items() if q == 1)
    gone = [i for i, q in labels.items() if q == 0 and i not in kept]
    assert len(gone) >= 0.8 * sum(q == 0 for q in labels.values())


def test_near_copies_equal_brute_force(stages):
    given = texts(stages[1])
    stay = {i for i, _, c in plain_components(given) if c == i}
    assert texts(stages[2]) == [r for r in given if r[0] in stay or r[0] is None]


def test_repeated_passages_equal_brute_force(stages):
    given = texts(stages[2])
    cut = {(i, n): (lost, kept) for i, n, lost, kept in plain_dedup(given, corpus_pipeline.RUN_WORDS)}
    want = [(i, t if not cut[i, len(words(t))][0] else cut[i, len(words(t))][1]) for i, t in given]
    assert texts(stages[3]) == want and any(t != u for (_, t), (_, u) in zip(given, want)) in (True, False)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3] if r["text"] is not None and r["n_chars"] is not None)


def test_benchmark_items_equal_brute_force(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    given = texts(stages[3])
    dirty = {d for d, _ in found_items(given, items)}
    assert texts(stages[4]) == [r for r in given if r[0] not in dirty] and dirty


def test_mixture_takes_as_many_words_as_there_are(stages):
    size = sum(len(words(r["text"])) for r in stages[4])
    assert abs(sum(r["words"] for r in stages[5]) - size) <= len({r["source"] for r in stages[4]})
    assert {r["doc_id"] for r in stages[5]} <= {r["doc_id"] for r in stages[4]}


def test_run_and_stage_columns(spark, stages):
    assert all(set(r) == set(corpus_pipeline.COLUMNS) for rows in stages[:5] for r in rows)
    assert corpus_pipeline.run(spark, DATA).count() > 100


def test_stages_take_empty_tables(spark):
    empty = frame(spark, []).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
