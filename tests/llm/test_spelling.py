import random
import re
import zlib
from collections import Counter

import pytest

from bagspark.llm import spelling as S
from tests.conftest import rows
from tests.llm.helpers import corpus, frame, lower


def plain_vocabulary(data, min_chars=5, min_count=3, every=97):
    seen = Counter()
    for r in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= min_chars:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(vocabulary, ratio=2):
    near = {w: [v for v in vocabulary if one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * vocabulary[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n, len(near[w]), vocabulary[form[w]] if form[w] else 0) for w, n in vocabulary.items())


def typed(seed=0, n=120):
    """Texts over words that are edits of each other, in skewed counts, with crowded beginnings and ends."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["Straße", "straße", "ÉCOLE", "école", "x" * 500, "x" * 501, "x" * 250 + "y" + "x" * 250]
    for _ in range(250):
        w = rng.choice(pool)
        k = rng.randrange(len(w))
        pool.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]]))
    data = [(i, rng.choice([" ", "-", "9", "\n"]).join(rng.choice(pool[: 1 + int(len(pool) * rng.random() ** 2)]) for _ in range(60))) for i in range(n)]
    return data + [(None, " ".join(pool)), (7, None), (8, ""), (3, data[3][1]), (3, data[3][1]), (900, " ".join(pool * 20))]


def result(spark, data, **more):
    return sorted((*r[:1], r[1] or "", *r[2:5], r[5] or 0) for r in rows(S.spelling_variants(frame(spark, data), **more)))


def test_equals_brute_force(spark):
    data = typed()
    expected = plain(plain_vocabulary(data))
    assert sum(r[4] > 0 for r in expected) > 100 and any(r[1] and r[1] != r[2] for r in expected)
    assert result(spark, data, drop_every=97) == expected


def test_crowded_tiles_are_split_and_nothing_is_lost_or_counted_twice(spark, monkeypatch):
    data = typed(1)
    monkeypatch.setattr(S, "TILE_WORDS", 3)
    monkeypatch.setattr(S, "PAIRS", 50)
    expected = plain(plain_vocabulary(data, 4, 2, None))
    assert result(spark, data, min_chars=4, min_count=2) == expected


def test_a_tile_stays_small_whatever_shares_a_beginning(spark):
    words = [("common" + a + b + c, 3) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"] + [("x" + "a" * 9, 5)]
    tiles = S.tiled(spark.createDataFrame(words, "word string, n long")).collect()
    assert max(len(t["members"]) for t in tiles) <= S.TILE_WORDS


def test_words_of_other_corpora_and_empty_tables(spark):
    data = corpus(3)
    assert result(spark, data, drop_every=97) == plain(plain_vocabulary(data))
    assert result(spark, []) == [] and result(spark, [(1, None), (2, "few few few")]) == []


def test_a_ratio_under_two_is_refused(spark):
    with pytest.raises(ValueError):
        S.spelling_variants(frame(spark, []), ratio=1)
