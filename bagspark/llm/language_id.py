"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are the runs of two, three and four bytes of the text with A-Z lower-cased and white space as one mark,
hashed into ``BUCKETS``. A text's vector is the mean embedding of all its subwords, so logits are means too and a
table bucket -> logits scores whole texts at a few array lookups per byte. Scores are calibrated by a temperature
fitted on texts kept out of training; texts whose score is under the calibrated bound are marked ``rejected``.

Training uses a documented, bounded sample: about ``SAMPLE`` texts per language, chosen by a hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.llm.packing import pack, unpack
from bagspark.llm.words import _IS_SPACE, _LOWER, as_bytes

SAMPLE = 1500
BUCKETS = 1 << 13
DIM = 16
EPOCHS = 12
BATCH = 32
RATE = 4.0
REJECT_RATE = 0.02
UNKNOWN = "und"
SLICE = 1 << 20
OUT = "doc_id long, lang_pred string, score double, rejected boolean"

_FOLD = np.where(_IS_SPACE, np.uint8(0x20), _LOWER).astype(np.uint64)
# Odd multipliers that hash byte runs.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per run length: (bucket at every byte where a run starts, 0/1 whether it stays within its text)."""
    b = _FOLD[data]
    last = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(b))
    buckets, inside = [], []
    code = b * _FACTORS[0]
    for k in (2, 3, 4):
        step = np.zeros(len(b), np.uint64)
        step[: max(len(b) - k + 1, 0)] = b[k - 1 :]
        code = code + step * _FACTORS[k - 1]
        h = code * _FACTORS[0]
        buckets.append(((h ^ (h >> np.uint64(29))) * _FACTORS[2] >> np.uint64(64 - 13)).astype(np.int64))
        inside.append(place + k <= last)
    return buckets, inside


def text_slices(texts: pa.Array):
    data, bounds = as_bytes(texts)
    n, at = len(bounds) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, side="right")) - 1)
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def counts(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: its buckets and how often each occurs."""
    buckets, inside = subwords(data, bounds)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = np.concatenate([x[a:b][ok[a:b]] for x, ok in zip(buckets, inside)])
        out.append(np.unique(own, return_counts=True))
    return out


@dataclass
class Model:
    """``table`` maps a bucket to its share of each language's logit; ``bound`` is the score under which texts are rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    bound: float

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.zeros((len(bounds) - 1, len(self.langs)))
        n = np.zeros(len(bounds) - 1)
        some = np.flatnonzero(np.diff(bounds))
        for bucket, inside in zip(*subwords(data, bounds)):
            part = self.table[bucket]
            part[~inside] = 0
            total[some] += np.add.reduceat(part, bounds[some], axis=0, dtype=np.float64) if len(some) else 0
            n += _inside(inside, bounds)
        return total / np.maximum(n, 1)[:, None] + self.bias


def _inside(inside: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(inside)])[bounds])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """SGD on the mean embeddings; every fifth row only sets the temperature and the rejection bound."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (bucket, n) in enumerate(rows):
        x[i, bucket] = n / max(n.sum(), 1)
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    head, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    target = np.eye(len(langs), dtype=np.float32)[y]
    steps, done = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            rate = RATE * (1 - done / steps)
            mean = x[at] @ embed
            error = (softmax(mean @ head + bias) - target[at]) / len(at)
            back = error @ head.T
            head -= rate * mean.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            used = np.flatnonzero(x[at].any(axis=0))
            embed[used] -= 50 * rate * x[np.ix_(at, used)].T @ back
            done += 1
    table = (embed @ head).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else train
    z = x[check] @ table + bias
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    return Model(langs, table, bias, temperature, float(np.quantile(right, REJECT_RATE)) if len(right) else 0.0)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from the rows with a language and a text; None if there are none.

    About ``sample`` rows per language are kept, by a hash of id and text.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod("h", F.lit(1 << 20)) < F.ceil(F.lit(sample * float(1 << 20)) / F.col("n"))
    chosen = rows.join(F.broadcast(sizes.where(F.col("n") > 0)), "lang").where(share).select("lang", "h", "text")

    def count(batches):
        for batch in batches:
            packed = [pack(np.stack([k, n]).astype(np.uint32).ravel()) for _, _, d, b in text_slices(batch.column(2)) for k, n in counts(d, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["lang", "h", "packed"])

    found = sorted((r["lang"], r["h"], bytes(r["packed"])) for r in chosen.mapInArrow(count, "lang string, h long, packed binary").collect())
    if not found:
        return None
    found.sort(key=lambda r: (r[1], r[0]))
    langs = sorted({r[0] for r in found})
    features = [unpack(r[2], np.uint32).astype(np.int64).reshape(2, -1) for r in found]
    return fit([(f[0], f[1]) for f in features], np.array([langs.index(r[0]) for r in found]), langs)


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script; only texts without a-z need a look at their characters."""
    ascii_letters = _inside(_ASCII_LETTER[data], bounds) > 0
    other = _inside(data >= 0x80, bounds) > 0
    for t in np.flatnonzero(~ascii_letters & other):
        ascii_letters[t] = any(map(str.isalpha, data[bounds[t] : bounds[t + 1]].tobytes().decode("utf-8", "replace")))
    return ascii_letters


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, rejected.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; without a model all are. Equal scores
    go to the language first in code point order. Null doc_ids stay null; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches):
        m = sent.value
        for batch in batches:
            name, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for at, end, data, bounds in text_slices(batch.column(1)) if m else ():
                p = softmax(m.logits(data, bounds) / m.temperature)
                known = has_letter(data, bounds)
                name[at:end][known] = np.array(m.langs, object)[p.argmax(axis=1)[known]]
                score[at:end][known] = p.max(axis=1)[known]
            low = (name == UNKNOWN) | (score < (m.bound if m else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(low.astype(bool))], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, OUT)
