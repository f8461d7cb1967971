import pytest

from bagspark.llm import mixing, queries
from bagspark.llm.mixing import mix, training_passes
from bagspark.session import materialise as mixing_materialise
from tests.llm.helpers import corpus, frame, words


def waterfill(sizes, weights):
    """Targets by repeated sharing of the excess."""
    target, open_, left = {}, dict(weights), sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in open_.items()}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
            del open_[s]
    return target


def named(rows, sources):
    return [(i, t, "en", sources[k % len(sources)]) for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("sources", [["b"] * 8 + ["a", "ß", None], ["é", "z", "Z", None], [None], ["only"]])
def test_targets_and_words_taken(spark, sources):
    rows = named(corpus(6), sources) + [(5000, None, None, "empty"), (None, "a b c", None, "b"), (7, "tie here", None, "b"), (7, "tie here", None, "b")]
    out = mix(frame(spark, rows)).collect()
    size = {s: sum(len(words(t)) for _, t, _, x in rows if x == s) for s in {r[3] for r in rows}}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = waterfill(size, {s: 1 + k % 3 for k, s in enumerate(order)})
    for s in order:
        own = [r for r in out if r.source == s]
        assert all(r.source_size == size[s] and r.target == pytest.approx(want[s]) for r in own)
        assert sum(r.words for r in own) == int(want[s] + 0.5)
    taken = {}
    for r in out:
        taken[r.doc_id, r.size] = taken.get((r.doc_id, r.size), 0) + r.words
    assert all(t <= 3 * n * sum(i == x[0] and len(words(x[1])) == n for x in rows) for (i, n), t in taken.items())
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    passes = [r for r in out if r.pass_no]
    assert all(0 <= r.position <= 1 for r in passes) and [r.position for r in passes] == sorted(r.position for r in passes)


def test_positions_follow_the_weight_schedule(spark):
    """In the first tenth of training a source has the share of the integral of its weights."""
    rows = [(k, "a b c d e f g h i j", None, "ab"[k % 2]) for k in range(4000)]
    out = [r for r in mix(frame(spark, rows), weights=(1, 3)).collect() if r.pass_no]
    for source, weight in (("a", 1), ("b", 3)):
        own = [r for r in out if r.source == source]
        early = sum(r.words for r in own if r.position < 0.1) / sum(r.words for r in own)
        assert early == pytest.approx((weight * 0.1 + (2 - weight) * 0.005) / ((weight + 2) / 2), abs=0.01)


def test_reruns_agree_on_other_partitions(spark):
    rows = named(corpus(7), ["a", "b", "c"])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(mix(frame(spark, rows))) == key(mix(frame(spark, rows[::-1]).repartition(7)))


def test_empty_table(spark):
    assert mix(frame(spark, [])).collect() == []


def test_every_row_has_its_own_passes(spark):
    """Rows that repeat a doc_id, and rows without one, are not merged."""
    rows = [(k, "a b c d", None, "ab"[k % 2]) for k in range(40)] + [(7, "tie here", None, "b")] * 3 + [(None, text, None, "a") for text in ("x y", "p q", "x y", None)]
    out = training_passes(frame(spark, rows), weights=(1, 9)).collect()
    assert sorted(((r.doc_id, r.size, r.source) for r in out), key=str) == sorted(((i, len(words(t)), s) for i, t, _, s in rows), key=str)
    assert len({(r.source, r.row_id) for r in out}) == len(rows)
    assert all(r.taken == sum(p.words for p in r.passes) <= 3 * r.size for r in out)
    want = {(r.source, r.row_id, r.pass_no, r.position, r.words) for r in mix(frame(spark, rows), weights=(1, 9)).collect() if r.pass_no}
    assert {(r.source, r.row_id, p.pass_no, p.position, p.words) for r in out for p in r.passes} == want
    assert all([p.position for p in r.passes] == sorted(p.position for p in r.passes) for r in out) and max(len(r.passes) for r in out) > 1


def test_query_runs_the_training_order(spark, monkeypatch, folder):
    """op8 reads its result back from sorted positions, one row per row of the table."""
    written = {}
    monkeypatch.setattr(mixing, "materialise", lambda df, name: written.setdefault(name, mixing_materialise(df, name)))
    rows = [(k, "a b c d", None, "ab"[k % 2]) for k in range(200)] + [(7, "tie here", None, "b")] * 3 + [(None, "x y", None, "a")] * 4
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    out = queries.op8(spark, folder).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
    positions = [r.position for r in written["order"].where("pass_no > 0").orderBy("position").collect()]
    assert len(positions) >= len(rows) // 2 and all(0 <= p <= 1 for p in positions)
    assert sum(r.taken for r in out) == written["order"].groupBy().sum("words").first()[0]
