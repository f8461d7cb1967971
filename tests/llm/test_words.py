import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from bagspark.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from bagspark.llm.words import SLICE_BYTES, run_hashes, runs, slices
from tests.llm.helpers import corpus, lower, words

TEXT = st.text(st.sampled_from("aB é\t\n\x0b\x0c\r  語"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 64))
def test_words_are_the_regular_expression_at_any_slice_size(texts, size):
    got = []
    for at, end, found in slices(pa.array(texts, pa.string()), lower=True, size=size):
        for t in range(end - at):
            own = range(found.first[t], found.first[t + 1])
            got.append([found.data[found.starts[w] : found.ends[w]].tobytes().decode() for w in own])
    assert got == [words(lower(t)) for t in texts]


def test_equal_words_and_runs_have_equal_hashes_and_others_do_not():
    texts = [t for _, t in corpus(3)]
    word_of, run_of = {}, {}
    for at, _, found in slices(pa.array(texts, pa.string()), size=SLICE_BYTES):
        h, flat = found.hashes(), [w for t in texts for w in words(t)]
        assert len(h) == len(flat)
        for value, w in zip(h, flat):
            assert word_of.setdefault(int(value), w) == w
        start, _ = runs(h, found.first, 3)
        for family in (0, 1):
            for value, s in zip(run_hashes(h, start, 3, family), start):
                assert run_of.setdefault((family, int(value)), tuple(flat[s : s + 3])) == tuple(flat[s : s + 3])
    assert len(word_of) == len({w for t in texts for w in words(t)})


@given(st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_packing_is_a_round_trip(values):
    a = np.array(sorted(values), np.uint64)
    assert (unpack(pack(a), np.uint64) == a).all() and (unpack_sorted(pack_sorted(a)) == a).all()
