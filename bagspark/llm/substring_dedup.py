"""Substring dedup: words covered by a run that also starts in an earlier document are removed.

Three passes over chunks of whole texts. The first sketches all runs of ``length`` words (count-min). The
second sends the runs whose estimate is two or more, and no others: the estimate is never too low, so none
that repeats is lost. They are grouped exactly by their fingerprint with the smallest doc_id that has them.
The third removes the covered words. A run that a third of all documents share is one entry per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from bagspark.llm import sketch
from bagspark.llm.chunks import SENT, carried, deal, merge, restored
from bagspark.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from bagspark.llm.words import run_hashes, runs, slices
from bagspark.session import materialise

SHARD_KEYS = 4 << 20
OUT = "doc_id long, n_words long, n_removed long, kept_text string"


def windows(table: pa.Table, length: int, families=(0, 1)) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list]:
    """(hash families of all runs, doc_id of each, run number at which each slice begins, slices).

    Rows without doc_id have no runs: they can be neither earlier nor later than another."""
    ids = table.column("doc_id")
    known = np.asarray(ids.is_valid())
    doc = ids.fill_null(0).to_numpy().astype(np.int64)
    hashed, owners, parts = [[] for _ in families], [], []
    for at, end, words in slices(table.column("text")):
        h = words.hashes()
        start, text = runs(h, words.first, length)
        if not known[at:end].all():
            ok = known[at:end][text]
            start, text = start[ok], text[ok]
        for k, family in enumerate(families):
            hashed[k].append(run_hashes(h, start, length, family))
        owners.append(doc[at:end][text])
        parts.append((at, end, words, start))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return [join(h, np.uint64) for h in hashed], join(owners, np.int64), parts


def entries(families: list[np.ndarray], doc: np.ndarray, candidate: np.ndarray):
    """Distinct fingerprints among the candidates, rising: (a, b, smallest doc_id, entry of each candidate)."""
    a, b, d = families[0][candidate], families[1][candidate].astype(np.uint32), doc[candidate]
    order = np.lexsort((d, b, a))
    a, b, d = a[order], b[order], d[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    entry = np.empty(len(a), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    return a[fresh], b[fresh], d[fresh], entry


def shard_shift(keys: int) -> int:
    """Leading bits of the fingerprint that name its shard, as a right shift (0 bits: one shard)."""
    return 64 - max(0, int(np.ceil(np.log2(max(1, keys / SHARD_KEYS)))))


def shard_of(a: np.ndarray, shift: int) -> np.ndarray:
    return (a >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(a), np.int64)


def bounds_of(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    return shard[starts], np.append(starts, len(shard))


def earliest(shard: int, table: pa.Table) -> list[dict]:
    """For every chunk, one bit per entry: does an earlier document of another chunk have the run?"""
    chunks = table.column("chunk").to_pylist()
    a = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    extra = [x for x in table.column("extra").to_pylist()]
    b = [unpack(x[8 : 8 + int.from_bytes(x[:8], "little")], np.uint32) for x in extra]
    d = [unpack(x[8 + int.from_bytes(x[:8], "little") :], np.int64) for x in extra]
    sizes = [len(x) for x in a]
    a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
    order = np.lexsort((d, b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = d[order][fresh][np.cumsum(fresh) - 1]
    earlier = np.empty(len(a), bool)
    earlier[order] = least < d[order]
    at = np.cumsum([0, *sizes])
    return [{"chunk": np.array(chunks, np.int32), "shard": np.full(len(chunks), -1 - shard, np.int32),
             "answer": [np.packbits(earlier[x:y]).tobytes() for x, y in zip(at[:-1], at[1:])]}]


def without(words, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, text offsets) of the words not covered, joined by one space within each text."""
    stay = ~covered
    starts, ends = words.starts[stay], words.ends[stay]
    owner = words.owner()[stay]
    more = np.zeros(len(starts), np.int64)
    more[:-1] = owner[:-1] == owner[1:]
    size = ends - starts + more
    total = int(size.sum())
    jump = np.cumsum(size) - size
    source = np.arange(total) + np.repeat(starts - jump, size)
    data = words.data[np.minimum(source, max(len(words.data) - 1, 0))] if total else np.zeros(0, np.uint8)
    data[(jump + size - 1)[more > 0]] = 0x20
    per_text = np.bincount(owner, size, minlength=len(words.first) - 1).astype(np.int64)
    return data, np.concatenate([[0], np.cumsum(per_text)])


def substring_dedup(docs: DataFrame, length: int = 13, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), keep_whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space), carried columns.

    A word goes if a run of ``length`` words that covers it also starts in a document with a smaller doc_id.
    With ``keep_whole``, texts that lose nothing come back as they are. Runs are judged on the input. Null text: no words. Rows with equal doc_id do not remove each other's words;
    rows with a null doc_id neither remove nor lose any. Texts shorter than ``length`` words stay whole. Other
    columns of ``docs`` are ignored unless ``carry`` names them. An empty table gives an empty result.
    """
    chunks = deal(docs, doc_id, text, carry)
    names = [f"carry_{i}" for i in range(len(carry))]
    keys = chunks.bytes // 5
    bits, shift = sketch.sketch_bits(keys), shard_shift(keys // 4)
    estimated = materialise(sketch.counted(chunks, lambda table: windows(table, length)[0], bits), "sketch")

    def send(chunk, table, answers):
        families, doc, _ = windows(table, length)
        a, b, d, _ = entries(families, doc, sketch.estimates(families, answers, bits) >= 2)
        shards, at = bounds_of(shard_of(a, shift))
        yield {"shard": shards.astype(np.int32), "chunk": np.full(len(shards), chunk, np.int32),
               "keys": [pack_sorted(a[x:y]) for x, y in zip(at[:-1], at[1:])],
               "extra": [len(p := pack(b[x:y])).to_bytes(8, "little") + p + pack(d[x:y]) for x, y in zip(at[:-1], at[1:])]}

    grouped = materialise(merge(chunks.answered(estimated, send, SENT), earliest), "repeated")

    def remove(chunk, table, answers):
        told = answers.filter(pc.less(answers.column("shard"), 0))
        families, doc, parts = windows(table, length)
        candidate = sketch.estimates(families, answers.filter(pc.greater_equal(answers.column("shard"), 0)), bits) >= 2
        a, _, d, entry = entries(families, doc, candidate)
        shards, at = bounds_of(shard_of(a, shift))
        bit = dict(zip(told.column("shard").to_pylist(), told.column("answer").to_pylist()))
        earlier = [np.unpackbits(np.frombuffer(bit[-1 - int(s)], np.uint8), count=y - x) for s, x, y in zip(shards, at[:-1], at[1:])]
        earlier = np.concatenate(earlier).astype(bool) if earlier else np.zeros(0, bool)
        gone = np.zeros(len(doc), bool)
        gone[candidate] = earlier[entry] | (d[entry] < doc[candidate])
        ids = table.column("doc_id").combine_chunks()
        done = 0
        for first, end, words, start in parts:
            lost = start[gone[done : done + len(start)]]
            done += len(start)
            step = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(step, lost, 1)
            np.add.at(step, np.minimum(lost + length, len(words.starts)), -1)
            covered = np.cumsum(step)[:-1] > 0
            data, offsets = without(words, covered)
            text = pa.LargeStringArray.from_buffers(end - first, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            removed = np.bincount(words.owner(), covered, minlength=end - first).astype(np.int64)
            if keep_whole:
                given = table.column("text").slice(first, end - first).combine_chunks()
                text = pc.if_else(pa.array(removed > 0), text.cast(given.type), given)
            yield {"doc_id": ids.slice(first, end - first), "n_words": words.counts, "n_removed": removed, "kept_text": text,
                   **{c: table.column(c).slice(first, end - first) for c in names}}

    both = estimated.unionByName(grouped)
    return restored(chunks.answered(both, remove, OUT + carried(docs, carry)), carry)
