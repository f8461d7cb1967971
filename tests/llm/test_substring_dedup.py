import pytest

from bagspark.llm import chunks
from bagspark.llm.substring_dedup import substring_dedup
from tests.llm.helpers import corpus, frame, words


def plain(rows, length):
    """Brute force: (doc_id, n_words, n_removed, kept text) per row."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - length + 1):
            if i is not None:
                run = tuple(w[k : k + length])
                first[run] = min(i, first.get(run, i))
    out = []
    for i, text in rows:
        w = words(text)
        gone = {k + j for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for j in range(length)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=str)


@pytest.mark.parametrize("length,size", [(13, 1 << 20), (4, 2000)])
def test_equals_brute_force_on_nulls_ties_and_repeated_rows(spark, monkeypatch, length, size):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", size)
    rows = corpus(1)
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[0][1]), (None, None), (-5, rows[3][1])]
    assert got(substring_dedup(frame(spark, rows), length)) == plain(rows, length)


def test_whole_texts_stay_as_they_are_and_columns_are_carried(spark):
    rows = [(1, "a  b\nc d e"), (2, "z a b c d y"), (3, None)]
    out = {r.doc_id: r for r in substring_dedup(frame(spark, rows), 3, carry=("lang", "chunk", "n_chars"), keep_whole=True).collect()}
    assert out[1].kept_text == "a  b\nc d e" and out[2].kept_text == "z y" and out[3].kept_text is None
    assert out[2].n_chars == 11 and out[2].chunk == "x" and out[2].lang is None


def test_empty_table(spark):
    assert substring_dedup(frame(spark, [])).collect() == []
