"""Grouping of spelling variants: words one edit apart, found in dense tiles of a vocabulary.

Two words, the longer of ``l`` code points, differ by one inserted, deleted or replaced code point exactly if their common prefix
and suffix together reach ``l - 1``. So one of the two is at least ``l // 2`` long, and words that share that prefix or that
suffix make a tile. A tile of more than ``TILE_WORDS`` words is split by the same argument on what is left between its common
prefix and suffix, and so on; a tile with one open place holds no more words than the alphabet has letters, so all tiles
end small, whatever the vocabulary. Tiles are compared as padded code-point matrices. A pair that meets in several tiles counts
in the one that takes the prefix wherever it can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagspark.session import materialise

RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"
TILE_WORDS = 256
PAIRS = 1 << 17
TILE = ("longer", "head_chars", "tail_chars", "under", "head", "tail")


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 5, min_count: int = 3, drop_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters of the whole texts, A-Z lower-cased, of ``min_chars`` and seen ``min_count`` times at least.

    With ``drop_every``, an occurrence whose hash crc32("<doc_id>:<run>") it divides loses the code point at hash % length first.
    A null text has no words; a null doc_id counts as the empty string.
    """
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    if drop_every is None:
        seen = runs.select(F.col("run").alias("word"))
    else:
        hashed = runs.where(F.length("run") >= min_chars).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        seen = hashed.select(F.when(F.col("h") % drop_every == 0, less).otherwise(F.col("run")).alias("word"))
    counted = seen.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def split(tiles: DataFrame) -> DataFrame:
    """Every member of a tile in the two tiles that share half of what was open: before it, or behind it.

    ``under`` bounds the common prefix of the pairs that count in a tile: those with a longer one count in the sister tile.
    """
    half = F.expr("(longer - head_chars - tail_chars) div 2").cast("int")
    longer = F.struct((F.col("head_chars") + half).alias("head_chars"), "tail_chars", "under")
    behind = F.struct("head_chars", (F.col("tail_chars") + half).alias("tail_chars"), F.least("under", F.col("head_chars") + half).alias("under"))
    parts = tiles.select("word", "n", "longer", F.explode(F.array(longer, behind)).alias("t")).select("word", "n", "longer", "t.*")
    return parts.select(
        "word", "n", "longer", "head_chars", "tail_chars", "under",
        F.substring("word", F.lit(1), F.col("head_chars")).alias("head"),
        F.substring("word", F.length("word") - F.col("tail_chars") + 1, F.col("tail_chars")).alias("tail"),
    )


def tiled(words: DataFrame) -> DataFrame:
    """(longer, under, members): all tiles of at least two words, each of at most ``TILE_WORDS`` or with one open place."""
    whole = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"))
    open_ = split(whole.select("*", F.lit(0).alias("head_chars"), F.lit(0).alias("tail_chars"), F.col("longer").alias("under")))
    out = None
    while True:
        open_ = materialise(open_, "tiles")
        crowded = open_.groupBy(*TILE).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > TILE_WORDS).where(F.expr("longer - head_chars - tail_chars > 1"))
        crowded = materialise(crowded.drop("_m"), "crowded")
        last = crowded.isEmpty()
        ready = open_ if last else open_.join(crowded, list(TILE), "left_anti")
        packed = ready.groupBy(*TILE).agg(F.collect_list(F.struct("word", "n")).alias("members")).where(F.size("members") > 1)
        packed = packed.select("longer", "under", "members")
        out = packed if out is None else out.unionByName(packed)
        if last:
            return out
        open_ = split(open_.join(crowded, list(TILE), "left_semi"))


def padded(words: list[str], width: int) -> np.ndarray:
    """Code points, one word per row, filled up with zeros."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), width), np.uint32)
    out[np.repeat(np.arange(len(words)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common beginning of each row of ``a`` and ``b``."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def compared(longer: int, under: np.ndarray, sizes: np.ndarray, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words one edit apart inside tiles that lie one after the other and whose longer words have ``longer`` letters."""
    front, back = padded(words, longer), padded([w[::-1] for w in words], longer)
    length = np.fromiter(map(len, words), np.int64, len(words))
    tile = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((-length, tile))  # the longer words of a tile first; each meets all behind it
    end = np.cumsum(sizes)[tile]
    partners = np.where(length[order] == longer, end - np.arange(len(order)) - 1, 0)
    reach = np.cumsum(partners)
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(reach, reach[lo] - partners[lo] + PAIRS, side="right")))
        left = np.repeat(np.arange(lo, hi), partners[lo:hi])
        right = left + 1 + np.arange(len(left)) - np.repeat(reach[lo:hi] - partners[lo:hi] - (reach[lo] - partners[lo]), partners[lo:hi])
        a, b = order[left], order[right]
        prefix = shared(front[a], front[b])
        near = (prefix + shared(back[a], back[b]) >= longer - 1) & (prefix < under[tile[left]])
        yield a[near], b[near]
        lo = hi


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit away, and the most frequent of them, the smallest on ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longer, under = (batch.column(c).to_numpy() for c in ("longer", "under"))
            members = batch.column("members")
            sizes, flat = members.value_lengths().to_numpy(zero_copy_only=False), members.flatten()
            first = np.cumsum(sizes) - sizes
            for value in np.unique(longer):
                at = np.flatnonzero(longer == value)
                take = np.repeat(first[at] - np.r_[0, np.cumsum(sizes[at])[:-1]], sizes[at]) + np.arange(sizes[at].sum())
                part = flat.take(pa.array(take))
                text, n = part.field("word").to_pylist(), part.field("n").to_numpy()
                rank = np.empty(len(text), np.int64)
                rank[np.argsort(np.array(text, object), kind="stable")] = np.arange(len(text))
                for a, b in compared(int(value), under[at], sizes[at], text):
                    own, other = np.r_[a, b], np.r_[b, a]
                    order = np.lexsort((rank[other], -n[other], own))
                    own, other = own[order], other[order]
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
                    best = other[starts]
                    names = pa.array(text, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(own[starts])), pa.array(np.diff(np.r_[starts, len(own)])), pa.array(n[best]), names.take(pa.array(best))],
                        ["word", "n_near", "best_n", "best"],
                    )

    found = tiled(words).mapInArrow(run, "word string, n_near long, best_n long, best string")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return merged.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form). Counts at least double along a chain, so few rounds are needed."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        nxt = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = nxt.select("word", "root")
        if nxt.where("_moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 5, min_count: int = 3, ratio: int = 2, drop_every: int | None = None
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of ``docs``; see ``vocabulary`` for what a word is.

    Words are near if one inserted, deleted or replaced code point makes one the other. ``form`` is the near word with the largest
    count (ties: the smallest by code points) if that is at least ``ratio`` times the word's own (``ratio`` is 2 or more, so
    chains end); ``root`` follows forms to the last. ``n_near`` counts near words. Null and empty texts have no words, an empty table gives no
    rows, repeated rows count again, runs of any length are whole words, and other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 a chain of forms need not end")
    words = materialise(vocabulary(docs, text, doc_id, min_chars, min_count, drop_every), "vocabulary")
    near = materialise(near_words(words), "near")
    has_form: Column = F.col("best_n") >= ratio * F.col("n")
    known = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")
    ), "forms")
    last = roots(known.where(F.col("form").isNotNull()))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
