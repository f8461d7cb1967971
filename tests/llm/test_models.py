"""Quality classifier, language identification and language-model scoring."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bagspark.llm import chunks, quality_classifier, queries
from bagspark.llm.language_id import UNKNOWN, predict, train
from bagspark.llm.lm_scoring import lm_scores
from bagspark.llm.quality_classifier import accepted, isotonic, quality_scores, statistics
from pyspark.sql import functions as F
from tests.llm.helpers import corpus, frame, lower, words


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(9)
    word = lambda: rng.choice(["stone", "river", "of", "the", "walking", "über"]) + rng.choice(["", "s", "ed"])
    good = [(k, " ".join(word() for _ in range(rng.randrange(20, 80)))) for k in range(120)]
    bad = [(200 + k, " ".join(word().upper() + "!!" for _ in range(30)) if k % 2 else "spam " * rng.randrange(20, 90)) for k in range(80)]
    return good, bad


def test_quality_on_unseen_rows(spark, graded):
    good, bad = graded
    rows = [*good, *bad, (900, None), (901, ""), (None, "x y"), (5, good[5][1])]
    labels = spark.createDataFrame([(i, int(i < 200), "x") for i, _ in good + bad] + [(None, 1, "x"), (7, None, "x"), (99999, 0, "x")], "doc_id long, quality int, text string")
    out = quality_scores(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    unseen = [r for r in out if r.held_out and (r.doc_id or 900) < 900]
    assert len(unseen) > 20 and all((r.score >= 0.3) == (r.doc_id < 200) for r in unseen)
    kept = sorted(((r.doc_id, r.text) for r in accepted(frame(spark, rows), labels, 0.3).collect()), key=str)
    fine = {r.doc_id for r in out if r.score >= 0.3}
    assert kept == sorted((r for r in rows if r[0] in fine), key=str)


def test_scores_do_not_depend_on_labels_of_held_out_rows(spark, graded):
    rows = [*graded[0], *graded[1]]
    docs = frame(spark, rows)
    held = {r.doc_id for r in docs.where(quality_classifier.held_out()).select("doc_id").collect()}
    label = lambda flip: spark.createDataFrame([(i, int((i < 200) != (flip and i in held))) for i, _ in rows], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in quality_scores(docs, label(flip)).collect()} for flip in (False, True))
    assert a == pytest.approx(b, abs=1e-9)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_scores(frame(spark, [(1, "a")]), none).collect()] == [0.5]
    assert quality_scores(frame(spark, []), none).collect() == []


def test_statistics_of_one_text():
    x = dict(zip(quality_classifier.STATISTICS, statistics(pa.array(["Ab ab ab! 1|\n#é"]))[0]))
    assert x["log_words"] == pytest.approx(math.log(6)) and x["capitals"] == pytest.approx(1 / 6) and x["pipes"] == pytest.approx(1 / 16)
    y = dict(zip(quality_classifier.STATISTICS, statistics(pa.array(["a a a b", None, "a a a b"]))[2]))
    assert y["distinct_words"] == 0.5 and y["doubled_words"] == 0.5


def test_isotonic_is_the_best_rising_fit():
    level = isotonic(np.array([0, 2, 1, 0, 3.0]), np.array([2, 2, 2, 0, 3.0]))
    assert level.tolist() == [0, 0.75, 0.75, 0.875, 1]


LANGS = {"aa": "mano tolu viri kasa", "bb": "strng krft wltz dpth", "cc": "öüä äöß üßö öäü"}


def spoken(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(LANGS[x].split()) + rng.choice(["", "a", "st"]) for _ in range(rng.randrange(1, 40))), x) for k in range(n) for x in [rng.choice(list(LANGS))]]


def test_languages_of_unseen_texts(spark):
    rows = spoken(300)
    learn, unseen = rows[:200], rows[200:]
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "12 !? 3", "bb"), (903, "ö", None), (None, "mano", None)]
    model = train(frame(spark, learn + extra))
    out = predict(frame(spark, unseen + extra), model).collect()
    assert len(out) == len(unseen) + len(extra)
    got = {r.doc_id: r for r in out}
    assert np.mean([got[i].lang_pred == x for i, _, x in unseen]) > 0.97
    assert all(got[i].lang_pred == UNKNOWN and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred == "cc" and got[None].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out)
    again = predict(frame(spark, unseen[::-1]).repartition(5), train(frame(spark, (learn + extra)[::-1]).repartition(3))).collect()
    assert {r.doc_id: r.lang_pred for r in again} == {i: got[i].lang_pred for i, _, _ in unseen}


def test_no_language_to_learn(spark):
    model = train(frame(spark, [(1, "a", None), (2, None, "aa")]))
    assert model is None and [r.lang_pred for r in predict(frame(spark, [(1, "a")]), model).collect()] == [UNKNOWN]
    assert predict(frame(spark, []), model).collect() == []


def plain_lm(rows, learns):
    texts = [[*words(lower(t)), None] for _, t in rows]
    n, pairs, left = Counter(), Counter(), Counter()
    for t, use in zip(texts, learns):
        if use:
            n.update(t)
            pairs.update(zip(["<s>", *t], t))
            left.update(["<s>", *t[:-1]])
    total, size = sum(n.values()), len(n)
    arcs, mass = Counter(v for v, _ in pairs), Counter()
    for (v, _), c in pairs.items():
        mass[v] += c
    p = lambda w: (n[w] + 0.1) / (total + 0.1 * (size + 1))
    assert all(mass[v] == left[v] for v in mass)
    over = lambda v: 1 - (mass[v] - 0.75 * arcs[v]) / max(left[v], 1)
    step = lambda v, w: (pairs[v, w] - 0.75) / left[v] + over(v) * p(w) if (v, w) in pairs else over(v) * p(w)
    return [(i, len(t), sum(n[w] > 0 for w in t), total, sum(math.log10(p(w)) for w in t), sum(math.log10(step(v, w)) for v, w in zip(["<s>", *t], t)))
            for (i, _), t in zip(rows, texts)]


@pytest.mark.parametrize("size,trained", [(1 << 20, True), (3000, True), (1 << 20, False)])
def test_language_model_equals_brute_force(spark, monkeypatch, size, trained):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", size)
    rows = corpus(10, vocabulary=3)
    rows += [rows[0], (None, rows[1][1]), (-2, None)]
    learns = [i is not None and i % 4 != 1 and trained for i, _ in rows]
    rule = (F.col("doc_id") % 4 != 1) & F.lit(trained)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scores(frame(spark, rows), rule, order=2).collect()), key=str)
    want = sorted(plain_lm(rows, learns), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [x for g in got for x in g[4:]] == pytest.approx([x for w in want for x in w[4:]], rel=1e-9, abs=1e-9)


def test_language_model_of_nothing(spark):
    assert lm_scores(frame(spark, []), F.lit(True)).collect() == []


def plain_trigrams(rows, learns):
    """Scores by all bigrams and trigrams of the training rows, also those seen once."""
    texts = [["<s>", *words(lower(t)), None] for _, t in rows]
    counts = [Counter(tuple(t[k : k + n]) for t, use in zip(texts, learns) if use for k in range(len(t) - n + 1) if n > 1 or k) for n in (1, 2, 3)]
    left, arcs = Counter(), Counter()
    for grams in counts[1:]:
        for g, c in grams.items():
            left[g[:-1]] += c
            arcs[g[:-1]] += 1

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 0.1) / (sum(counts[0].values()) + 0.1 * (len(counts[0]) + 1))
        head, lower_order = gram[:-1], p(gram[1:])
        if not left[head]:
            return lower_order
        return max(counts[len(gram) - 1][gram] - 0.75, 0) / left[head] + 0.75 * arcs[head] / left[head] * lower_order

    return [(i, sum(math.log10(p(tuple(t[max(0, k - 2) : k + 1]))) for k in range(1, len(t)))) for (i, _), t in zip(rows, texts)]


@pytest.mark.parametrize("size", [1 << 20, 3000])
def test_query_model_keeps_rare_bigrams_and_trigrams(spark, monkeypatch, folder, size):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", size)
    rows = corpus(11, vocabulary=3)
    rows += [rows[0], (None, rows[1][1]), (-2, None)]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    out = queries.op6(spark, folder).collect()
    held = {r.doc_id: r.held_out for r in out}
    assert {False, True} <= set(held.values())
    want = sorted(plain_trigrams(rows, [held[i] is False for i, _ in rows]), key=str)
    got = sorted(((r.doc_id, r.score) for r in out), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9, abs=1e-9)
