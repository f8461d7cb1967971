import random

import pytest

from bagspark.llm import chunks, jaccard_join
from bagspark.llm import components as components_module
from bagspark.llm.components import components
from bagspark.llm.jaccard_join import jaccard_components, jaccard_links, one_per_component
from tests.llm.helpers import corpus, frame, lower, words


def shingles(text):
    w = words(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows):
    """Brute force: every pair, then the smallest reachable doc_id. Rows without an id stay alone."""
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(shingles(t)), None if i is None else find(i)) for i, t in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,size,block", [(1, 1 << 20, 2000), (2, 3000, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, size, block):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", size)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "OFFERS", 1 if block == 3 else 8)
    monkeypatch.setattr(components_module, "LOCAL_EDGES", 0 if block == 3 else 1 << 20)
    rows = corpus(seed, 80)
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[0][1]), (None, None)]
    assert got(jaccard_components(frame(spark, rows))) == plain(rows)


def test_chains_and_groups_that_only_meet_away_from_their_hub(spark, monkeypatch):
    """Sliding windows over one text: neighbours are similar, far ones are not."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(400)]
    order = list(range(40))
    rng.shuffle(order)
    rows = [(i, " ".join(base[9 * k : 9 * k + 60])) for i, k in enumerate(order) if k not in (13, 29)]
    assert got(jaccard_components(frame(spark, rows))) == plain(rows)


def test_threshold_is_met_exactly(spark):
    a = [f"k{k}" for k in range(11)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1] + ["z"])), (3, " ".join(a + ["q", "r"])), (4, " ".join(a + ["s", "t", "u"]))]
    assert got(jaccard_components(frame(spark, rows))) == plain(rows)


def test_one_document_of_each_component_stays(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (9, None), (8, ""), (3, "B"), (None, "a b c d e f"), (None, None)]
    out = one_per_component(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, "A b c d e f"), (9, None), (8, ""), (None, "a b c d e f"), (None, None)], key=str)


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components_of_a_path_a_star_and_loops(spark, monkeypatch, local):
    monkeypatch.setattr(components_module, "LOCAL_EDGES", local)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_empty_table(spark):
    assert jaccard_components(frame(spark, [])).collect() == []


@pytest.mark.parametrize("block", [500, 3])
def test_links_are_all_similar_pairs(spark, monkeypatch, block):
    """Also those within one component, which the components need not compare."""
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", block)
    base = [f"n{k}" for k in range(120)]
    near = [(5000 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(0, 120, 6)]
    rows = list({i: t for i, t in [*corpus(4, 80), *near, (7000, near[0][1]), (7001, near[0][1].upper())]}.items())
    first = {}
    for i, t in sorted(rows):
        first.setdefault(frozenset(shingles(t)), i)
    sets = sorted((i, s) for s, i in first.items() if s)
    want = {(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if 100 * len(a & b) >= 75 * len(a | b)}
    docs = frame(spark, [*rows, (None, near[0][1])])
    out = [(r.a, r.b) for r in jaccard_links(docs).collect()]
    assert sorted(out) == sorted(want) and sum(5000 <= i <= j < 7000 for i, j in out) == 190
    counted = jaccard_components(docs, with_links=True)
    assert got(counted) == plain([*rows, (None, near[0][1])])
    links = {i: sum(first[frozenset(shingles(t))] in pair for pair in want) if shingles(t) else 0 for i, t in rows} | {None: 0}
    assert {r.doc_id: r.n_links for r in counted.collect()} == links


def test_no_links(spark):
    assert jaccard_links(frame(spark, [])).collect() == []
