"""Language-model scoring by a weighted backoff automaton over word trigrams or bigrams.

States are the bigrams and the words seen in training, the start, and one empty state. A bigram that occurs
in training is an arc from its first word, a trigram from its first two, with its smoothed probability. Every state has a
failure arc to the state of its last word, a word state to the empty one, that carries the mass left over; the empty state
has an arc for every token, also for unknown ones. Texts are read once from left to right: the state follows the tokens and
the log-probabilities add up.

    P(w | u v) = (c(u v w) - D) / c(u v) + b(u v) P(w | v)   if u v w is an arc
    P(w | u v) = b(u v) P(w | v)                             else, over the failure arc
    P(w | v)   = (c(v w) - D) / c(v) + b(v) P(w)             if v w is an arc
    P(w | v)   = b(v) P(w)                                   else, over the failure arc
    P(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    b(h)       = 1 - sum over arcs of h of (c - D) / c(h) = D arcs(h) / c(h), or 1 without arcs

The sums need no exchange of their own: every n-gram is an arc, so the counts of a context's arcs add up to its own count.

All counts are exact and over all training texts. No table of words is sent to all tasks: every chunk of texts asks
for the numbers of its own words, bigrams and trigrams (``ledger``) and builds the part of the automaton that its texts
can reach. A sketch tells which of them may occur in other chunks: its estimates are never too low, so a key that is
estimated as often as the chunk has it is in this chunk only. Its count is known there and never sent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagspark.llm import ledger, sketch
from bagspark.llm.chunks import SENT, deal, merge
from bagspark.llm.words import mix, slices
from bagspark.session import materialise

DISCOUNT = 0.75
ADDED = 0.1
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"
FINER = 2
SLICE = 1 << 17
"""Texts are cut to words so many bytes at a time: working arrays then stay in the caches."""


def bigrams(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9FB21C651E98DF25) + token)


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rising distinct keys, the place of each key among them); quick where keys repeat often, as words do."""
    found = pa.array(keys, pa.uint64()).dictionary_encode()
    distinct = found.dictionary.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[found.indices.to_numpy()]


def runs_of(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each occurs) of sorted ones."""
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def tallied(keys: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rising distinct keys, how often each occurs, how often among those in use) where the place of each key is not asked for."""
    own, times = runs_of(np.sort(keys))
    used, n = runs_of(np.sort(keys[use]))
    here = np.zeros(len(own), np.int64)
    here[np.searchsorted(own, used)] = n
    return own, times, here


def elsewhere(estimate: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Whether a key may occur in other chunks too."""
    return (estimate > times) | (estimate == sketch.TOP)


def kept_back(arcs: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The share that a state leaves to its failure arc."""
    return np.where(arcs > 0, DISCOUNT * arcs / np.maximum(left, 1), 1.0)


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, hash of the token before, first token of each text, whether the token is in training) of a chunk."""
    parts, sizes = [], []
    for _, _, words in slices(table.column("text"), lower=True, size=SLICE):
        n = len(words.counts)
        out = np.full(len(words.starts) + n, END, np.uint64)
        out[np.arange(len(words.starts)) + words.owner()] = words.hashes()
        parts.append(out)
        sizes.append(words.counts + 1)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = START
    learns = np.asarray(table.column("carry_0").combine_chunks()).astype(bool)
    return token, before, first, np.repeat(learns, sizes)


@dataclass
class Automaton:
    """The part that a chunk's texts can reach. Arcs and states are found by their place in the sorted keys."""

    empty_arc: np.ndarray
    failure: np.ndarray
    arc: np.ndarray
    pair_failure: np.ndarray
    pair_arc: np.ndarray

    def walk(self, word: np.ndarray, pair: np.ndarray, bigram: np.ndarray, trigram: np.ndarray, state: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of every text, all texts in step from left to right.

        ``word`` and ``pair`` are the places of each token and of the bigram that it ends, ``bigram`` and ``trigram`` those of
        arcs (-1: no arc); ``state`` is the place of the state in which a text starts.
        """
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        total = np.zeros(len(length))
        kept, pair_kept, pair_failure = np.append(self.arc, 0.0), np.append(self.pair_arc, 0.0), np.append(self.pair_failure, 0.0)
        now, last = state[order], np.full(len(length), -1)
        active = np.searchsorted(-length[order], -np.arange(length.max() if len(length) else 0), side="left")
        for t, n in enumerate(active):
            at = first[order[:n]] + t
            w, arc, longer = word[at], bigram[at], trigram[at]
            lower = np.where(arc >= 0, kept[arc], self.failure[now[:n]] + self.empty_arc[w])
            total[:n] += np.where(longer >= 0, pair_kept[longer], pair_failure[last[:n]] + lower)
            now[:n], last[:n] = w, pair[at]
        out = np.empty(len(length))
        out[order] = total
        return out


def lm_scores(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``learn`` is true (null: not). Tokens are the words with A-Z lower-cased, then one end;
    null and empty texts are just the end. ``base_score`` adds log10 P(token), ``score`` is the automaton's, of ``order`` 2 or
    3; every n-gram of the training texts is an arc. Rows that repeat count each time. Without training rows every token has the same unigram probability of one. Other
    columns are ignored.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    flagged = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learns"))
    chunks = deal(flagged, carry=("learns",))
    bits = sketch.sketch_bits(chunks.bytes // 5) + FINER + order - 2
    shift = ledger.shift_for(chunks.bytes // 16)

    def look(table):
        """Tokens, the places of those that end a trigram, and the hashes of bigrams and trigrams."""
        token, before, first, learns = tokens(table)
        keys = [bigrams(before, token)]
        later = np.ones(len(token), bool)
        later[first[:-1]] = False
        inner = np.flatnonzero(later) if order > 2 else np.zeros(0, np.int64)
        return token, first, learns, inner, [*keys, bigrams(keys[0][inner - 1], token[inner])]

    estimated = materialise(sketch.counted(chunks, lambda table: [np.concatenate(look(table)[4])], bits), "sketch")

    def kind(answers, k):
        return answers.filter(pc.equal(answers.column("kind"), k))

    def grams(table, answers):
        """Tokens, and for bigrams and trigrams: rising keys, each one's place, training counts here, whether others may have the key."""
        token, first, learns, inner, keys = look(table)
        seen = [np.unique(k, return_inverse=True, return_counts=True) for k in keys]
        estimate = sketch.estimates([np.concatenate([own for own, _, _ in seen])], kind(answers, 0), bits)
        found = [
            (own, at, np.bincount(at, use, minlength=len(own)).astype(np.int64), elsewhere(e, times))
            for (own, at, times), e, use in zip(seen, np.split(estimate, [len(seen[0][0])]), (learns, learns[inner]))
        ]
        return token, first, learns, inner, found

    def totals(own, spread, columns, answers):
        """Totals over all chunks by column and key, and whether the chunk owns the key."""
        out, owned = np.stack(columns), np.ones(len(own), bool)
        out[:, spread], owned[spread] = ledger.read(own[spread], answers, len(columns), shift)
        return out, owned

    def longer(inner, found, answers):
        """Totals of trigrams, the places of their first and last two words, and the columns that bigrams send."""
        (pairs, pair_at, here, _), (own, at, own_here, spread) = found
        (count,), owned = totals(own, spread, [own_here], kind(answers, 1))
        origin, target = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        origin[at], target[at] = pair_at[inner - 1], pair_at[inner]
        arcs = np.bincount(origin[owned & (count > 0)], minlength=len(pairs)).astype(np.int64)
        return count, origin, target, [here, arcs]

    def send_trigrams(chunk, table, answers):
        _, _, learns, inner, keys = look(table)
        pairs, (own, times, here) = runs_of(np.sort(keys[0]))[0], tallied(keys[1], learns[inner])
        estimate = sketch.estimates([np.concatenate([pairs, own])], kind(answers, 0), bits)
        spread = elsewhere(estimate[len(pairs) :], times)
        yield ledger.send(chunk, own[spread], [here[spread]], shift)

    def send_pairs(chunk, table, answers):
        _, _, _, inner, found = grams(table, answers)
        own, _, _, spread = found[0]
        yield ledger.send(chunk, own[spread], [c[spread] for c in longer(inner, found, answers)[3]], shift)

    def answered(send, columns, lowest, name):
        return materialise(merge(chunks.answered(told, send, SENT), ledger.total_up(columns, lowest), ledger.TOTALS), name)

    def told_by(df, k):
        return df.where("chunk >= 0").select("chunk", "shard", "answer", F.lit(k).alias("kind"))

    told = estimated.withColumn("kind", F.lit(0))
    if order > 2:
        told = told.unionByName(told_by(answered(send_trigrams, 1, 1, "trigrams"), 1))
    told = told.unionByName(told_by(answered(send_pairs, 2, 1, "bigrams"), 2))

    def contexts(table, answers):
        """Words and their places, trigrams and bigrams with totals, and where bigrams start and end."""
        token, first, learns, inner, found = grams(table, answers)
        three = longer(inner, found, answers)
        own, place, _, spread = found[0]
        two, owned = totals(own, spread, three[3], kind(answers, 2))
        word, at = placed(np.append(token, START))
        at_start, at = int(at[-1]), at[:-1]
        from_place = np.empty(len(token), np.int64)
        from_place[1:] = at[:-1]
        from_place[first[:-1]] = at_start
        origin, target = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        origin[place], target[place] = from_place, at
        return word, at, from_place, at_start, first, learns, inner, found, three, two, owned, origin, target

    def send_words(chunk, table, answers):
        word, at, from_place, _, _, learns, _, _, _, (count, _), owned, origin, _ = contexts(table, answers)
        n = np.bincount(at, learns, minlength=len(word)).astype(np.int64)
        left = np.bincount(from_place, learns, minlength=len(word)).astype(np.int64)
        arcs = np.bincount(origin[owned & (count > 0)], minlength=len(word)).astype(np.int64)
        yield ledger.send(chunk, word, [n, left, arcs], shift)

    words = answered(send_words, 3, 0, "words")
    sizes = words.where("chunk = -1").agg(F.sum("n_keys"), F.sum("total")).first()
    distinct, trained = sizes[0] or 0, sizes[1] or 0
    told = told.unionByName(told_by(words, 3))

    def score(chunk, table, answers):
        word, at, _, at_start, first, _, inner, found, three, two, _, origin, target = contexts(table, answers)
        (n, left, arcs), _ = ledger.read(word, kind(answers, 3), 3, shift)
        p = (n + ADDED) / (trained + ADDED * (distinct + 1))
        over = kept_back(arcs, left)
        left = np.maximum(left, 1)
        count, pair_arcs = two
        p_pair = over[origin] * p[target] + np.where(count > 0, (count - DISCOUNT) / left[origin], 0.0)
        pair_over = kept_back(pair_arcs, count)
        pair_left = np.maximum(count, 1)
        often, pair_origin, pair_target, _ = three
        p_three = pair_over[pair_origin] * p_pair[pair_target] + np.where(often > 0, (often - DISCOUNT) / pair_left[pair_origin], 0.0)
        automaton = Automaton(np.log10(p), np.log10(over), np.log10(p_pair), np.log10(pair_over), np.log10(p_three))
        pair, place = found[0][1], found[1][1]
        trigram = np.full(len(at), -1)
        trigram[inner] = np.where(often[place] > 0, place, -1)
        yield {"doc_id": table.column("doc_id"), "n_tokens": np.diff(first), "n_known": np.add.reduceat((n[at] > 0).astype(np.int64), first[:-1]),
               "base_score": np.add.reduceat(automaton.empty_arc[at], first[:-1]),
               "score": automaton.walk(at, pair, np.where(count[pair] > 0, pair, -1), trigram, np.full(len(first) - 1, at_start), first)}

    scored = chunks.answered(told, score, OUT)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")
