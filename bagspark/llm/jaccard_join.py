"""N-gram Jaccard join: documents whose sets of word shingles have similarity 0.75 or more, as components.

Equal sets are joined first by a 128-bit fingerprint, so only one document of each class goes on. Two similar sets
share one of their rarest shingles: with all shingles in one order, rare first, those among the first
n - ceil(0.75 n) + 1 of each. A count-min sketch of the classes' shingles gives the order; its estimates are never too
low, so a shingle estimated once is in one set only, and a document whose rare part holds nothing else links with
nothing. The others form tiles, one per shared rare shingle.

Within a tile sets are banded by size and hashed to bitmaps. A bit set in one bitmap and not in the other proves a
shingle that is not shared, so bit counts bound the overlap from above; pairs that pass are decided by
intersecting the sorted sets. First each tile is only compared with its smallest document (a star); what that
joins is contracted, and just tiles that still hold several components are compared within, in blocks, skipping
pairs already joined. So a group of near copies costs about one comparison per copy.

Whole sets only go to stars and to pairs that pass the bound; tiles get the bitmaps. A first round only takes the
tiles of every sixteenth shingle: similar sets mostly share many, so this joins most of what belongs together. The
next takes all tiles that are left. A block offers at first a few pairs per set; if it had more, the
round is repeated for its tile on the contracted components with more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.llm import sketch
from bagspark.llm.chunks import SENT, carried, deal, merge, restored
from bagspark.llm.components import components
from bagspark.llm.words import mix, run_hashes, runs, slices
from bagspark.session import materialise

SHINGLE = 5
PART, WHOLE = 75, 100
BLOCK = 2000
LINK_BLOCK = 500
EVERY = 1 << 40
CLASS = "chunk int, doc_id long, n_shingles long, f1 long, f2 long"
SIGNED = "node long, n long, tokens array<long>, map binary, members binary"
EDGES = "a long, b long"
PAIRS = "a long, b long, more boolean, token long"
OFFERS = 8
BITS_PER_SHINGLE = 16
FIRST_SHARE = 16


def shingle_sets(texts, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rising distinct shingle hashes of each text, one text after the other; offset of each text's set)."""
    sets, sizes = [], []
    for at, end, words in slices(texts, lower=True):
        h, counts = words.hashes(), words.counts
        start, text = runs(h, words.first, SHINGLE)
        pieces = [(run_hashes(h, start, SHINGLE), text)]
        for n in range(1, SHINGLE):
            short = np.flatnonzero(counts == n)
            pieces.append((run_hashes(h, words.first[short], n), short))
        value, owner = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
        if chosen is not None:
            stay = chosen[at:end][owner]
            value, owner = value[stay], owner[stay]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(end - at + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            value[a:b].sort()
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        sets.append(value[fresh])
        sizes.append(np.bincount(owner[fresh], minlength=end - at))
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def set_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values per set, modulo 2^64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def families(sets: np.ndarray) -> list[np.ndarray]:
    return [sets, mix(sets + np.uint64(0x5851F42D4C957F2D))]


def needed(a, b):
    """The least overlap with which sets of sizes a and b are similar."""
    return -(-PART * (a + b) // (PART + WHOLE))


def width_of(n: int) -> int:
    return max(64, 1 << int(np.ceil(np.log2(BITS_PER_SHINGLE * n))))


def bitmap(members: np.ndarray) -> bytes:
    """Bit (hash mod width) of each member; the width is a power of two, so halves can be folded together."""
    width = width_of(len(members))
    dense = np.zeros(width, bool)
    dense[(members & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(dense, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of similar sizes at the smallest of their widths, one row of 64-bit words each."""
    width = min(map(len, maps))
    rows = np.zeros((len(maps), width), np.uint8)
    for row, m in zip(rows, maps):
        for at in range(0, len(m), width):
            row |= np.frombuffer(m, np.uint8, width, at)
    return rows.view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def bound(pivot: int, others: np.ndarray, sizes: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """The largest overlap with ``pivot`` that the bit counts allow, per other set."""
    own = np.bitwise_count(maps[pivot] & ~maps[others]).sum(axis=1, dtype=np.int64)
    theirs = np.bitwise_count(maps[others] & ~maps[pivot]).sum(axis=1, dtype=np.int64)
    return np.minimum(sizes[pivot] - own, sizes[others] - theirs)


def bands(sizes: np.ndarray) -> np.ndarray:
    """Similar sizes are in the same or in neighbouring bands."""
    return np.floor(np.log(sizes) / np.log(WHOLE / PART) + 1e-9).astype(np.int64)


def offers(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, maps: list[bytes], side: np.ndarray, most: int) -> Iterator[tuple[int, int, bool]]:
    """Pairs of different components in a tile whose bit counts allow a link: (a, b, whether more were held back).

    ``side`` 0 and 1 are compared with each other, 2 with all of its kind. Of the pairs of one set the ``most``
    likely ones are offered.
    """
    band = bands(sizes)
    for b in np.unique(band):
        rows = np.flatnonzero((band == b) | (band == b + 1))
        label, n, own_side = labels[rows], sizes[rows], side[rows]
        if len(np.unique(label)) < 2:
            continue
        bits = folded([maps[r] for r in rows])
        for x in np.flatnonzero(band[rows] == b):
            other = np.arange(len(rows))
            near = ((band[rows] == b + 1) | (other > x)) & (label != label[x]) & ((own_side == 2) | (own_side != own_side[x]))
            other = other[near & (PART * np.maximum(n, n[x]) <= WHOLE * np.minimum(n, n[x]))]
            if len(other):
                room = bound(x, other, n, bits) - needed(n[x], n[other])
                other, room = other[room >= 0], room[room >= 0]
                for y in other[np.argsort(-room, kind="stable")[:most]]:
                    yield int(nodes[rows[x]]), int(nodes[rows[y]]), len(other) > most


def edges_table(links, names=("a", "b")) -> pa.Table:
    columns = list(zip(*links)) if links else [()] * len(names)
    return pa.table({n: pa.array(c, pa.bool_() if n == "more" else pa.int64()) for n, c in zip(names, columns)})


def star_links(table: pa.Table) -> pa.Table:
    """Members of one hub's tiles that are similar to the hub (the row with node = hub)."""
    nodes, hub = table.column("node").to_numpy(), table.column("hub")[0].as_py()
    sizes, maps, members = table.column("n").to_numpy(), table.column("map").to_pylist(), table.column("members").to_pylist()
    pivot = int(np.flatnonzero(nodes == hub)[0])
    near = np.flatnonzero((PART * np.maximum(sizes, sizes[pivot]) <= WHOLE * np.minimum(sizes, sizes[pivot])) & (nodes != hub))
    if not len(near):
        return edges_table([])
    rows = np.append(near, pivot)
    bits, n = folded([maps[r] for r in rows]), sizes[rows]
    likely = near[bound(len(near), np.arange(len(near)), n, bits) >= needed(n[-1], n[:-1])]
    centre = np.frombuffer(members[pivot], np.uint64)
    links = [(int(nodes[y]), hub) for y in likely if overlap(centre, np.frombuffer(members[y], np.uint64)) >= needed(sizes[pivot], sizes[y])]
    return edges_table(links)


def block_offers(most: int):
    """The kernel for two blocks of a tile, or for one with itself."""

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        block = table.column("block").to_numpy()
        side = np.full(len(block), 2) if left == right else (block == right).astype(np.int64)
        found = offers(table.column("node").to_numpy(), table.column("label").to_numpy(), table.column("n").to_numpy(), table.column("map").to_pylist(), side, most)
        token = table.column("token")[0].as_py()
        return edges_table([(*f, token) for f in found], ("a", "b", "more", "token"))

    return kernel


def true_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, members, other) that are similar."""
    for batch in batches:
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
        yield batch.select([0, 1]).filter(pa.array([overlap(x, y) >= needed(len(x), len(y)) for x, y in zip(*sets)], pa.bool_()))


def signed(docs_chunks, classes: DataFrame, bits: int) -> DataFrame:
    """(node, n, tokens, members) of the classes that may link: their shared rare shingles and their whole sets."""
    holders = classes.select("chunk", "doc_id")

    def chosen(table, given):
        ids = table.column("doc_id").fill_null(0).to_numpy()
        known = np.asarray(table.column("doc_id").combine_chunks().is_valid())
        return known & np.isin(ids, given.column("doc_id").to_numpy()), ids

    def count(chunk, table, given):
        sets, _ = shingle_sets(table.column("text"), chosen(table, given)[0])
        yield from sketch.send(chunk, families(sets), bits)

    estimated = materialise(merge(docs_chunks.answered(holders, count, SENT), sketch.add_up), "sketch")

    def rare(chunk, table, given):
        told, answers = given.filter(pc.is_null(given.column("shard"))), given.filter(pc.is_valid(given.column("shard")))
        mask, ids = chosen(table, told)
        sets, bounds = shingle_sets(table.column("text"), mask)
        estimate = sketch.estimates(families(sets), answers, bits)
        n = np.diff(bounds)
        alone = np.diff(np.concatenate([[0], np.cumsum(estimate < 2)])[bounds])
        first = n - -(-PART * n // WHOLE) + 1 - alone
        chosen_rows, tokens = [], []
        for t in np.flatnonzero((n > 0) & (first > 0)):
            own, e = sets[bounds[t] : bounds[t + 1]], estimate[bounds[t] : bounds[t + 1]]
            shared = np.flatnonzero(e >= 2)
            chosen_rows.append(t)
            tokens.append(own[shared[np.argsort(e[shared], kind="stable")[: first[t]]]].view(np.int64))
        yield {"node": ids[chosen_rows], "n": n[chosen_rows], "tokens": pa.array(tokens, pa.list_(pa.int64())),
               "map": [bitmap(sets[bounds[t] : bounds[t + 1]]) for t in chosen_rows],
               "members": [sets[bounds[t] : bounds[t + 1]].tobytes() for t in chosen_rows]}

    both = estimated.unionByName(holders, allowMissingColumns=True)
    return materialise(docs_chunks.answered(both, rare, SIGNED), "signed")


def star_edges(tokens: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between every set and the smallest set of each of its tiles."""
    hubs = tokens.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").drop("top")
    pairs = materialise(tokens.join(hubs, "token").where("node <> hub").select("hub", "node").distinct(), "stars")
    ways = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ways"))
    dealt = pairs.join(ways, "hub").withColumn("way", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")).drop("ways")
    centres = ways.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    rows = dealt.unionByName(centres).join(sets.select("node", "n", "map", "members"), "node")
    return rows.groupBy("hub", "way").applyInArrow(star_links, EDGES)


def tile_offers(tokens: DataFrame, sets: DataFrame, labels: DataFrame, most: int, block: int | None = None) -> DataFrame:
    """(a, b, more): pairs of components that still meet in a tile. Tiles with the same members are compared once."""
    named = tokens.join(labels, "node", "left").select("token", "node", F.coalesce("component", "node").alias("label"))
    tiles = named.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("k1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("k2"),
    ).where("low <> high")
    once = tiles.groupBy("size", "k1", "k2").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("size") / (block or BLOCK)).cast("int").alias("blocks"))
    members = named.join(once, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", "node", "label", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    )
    rows = spread.join(sets.select("node", "n", "map"), "node")
    return rows.groupBy("token", "left", "right").applyInArrow(block_offers(most), PAIRS)


def tile_edges(tokens: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and those found within tiles, round by round until no block held a pair back.

    A tile of which nothing was held back is settled: all its pairs that could be links were decided.
    """
    most, share, left = OFFERS, FIRST_SHARE, tokens
    while True:
        some = left.where(F.pmod("token", F.lit(share)) == 0)
        offered = materialise(tile_offers(some, sets, components(links), most), "offers")
        other = sets.select(F.col("node").alias("b"), F.col("members").alias("other"))
        pairs = offered.select("a", "b").distinct().join(sets.select(F.col("node").alias("a"), "members"), "a").join(other, "b")
        links = materialise(links.unionByName(pairs.select("a", "b", "members", "other").mapInArrow(true_pairs, EDGES)), "links")
        if share > 1:
            share = 1
            continue
        held = offered.where("more").select("token").distinct()
        if held.isEmpty():
            return links
        most, left = most * 16, left.join(held, "token", "left_semi")


def all_links(tokens: DataFrame, sets: DataFrame) -> DataFrame:
    """Every similar pair (a, b), a < b: all tiles are compared within, nothing is contracted or held back."""
    own = sets.select("node", F.col("node").alias("component")).distinct()
    met = tile_offers(tokens, sets, own, EVERY, LINK_BLOCK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    offered = materialise(met.distinct(), "offers")
    other = sets.select(F.col("node").alias("b"), F.col("members").alias("other"))
    pairs = offered.join(sets.select(F.col("node").alias("a"), "members"), "a").join(other, "b")
    return materialise(pairs.select("a", "b", "members", "other").mapInArrow(true_pairs, EDGES).distinct(), "links")


def prepared(chunks) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with sizes and fingerprints, classes of equal sets, sets that may link, their shared rare shingles)."""
    bits = sketch.sketch_bits(chunks.bytes // 5)

    def describe(chunk, table):
        sets, bounds = shingle_sets(table.column("text"))
        yield {"chunk": np.full(len(bounds) - 1, chunk, np.int32), "doc_id": table.column("doc_id"), "n_shingles": np.diff(bounds),
               "f1": set_sums(mix(sets), bounds).view(np.int64), "f2": set_sums(mix(sets ^ np.uint64(0xA0761D6478BD642F)), bounds).view(np.int64)}

    rows = materialise(chunks.send(describe, CLASS), "described")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    keys = ["n_shingles", "f1", "f2"]
    classes = full.groupBy(*keys).agg(F.min(F.struct("doc_id", "chunk")).alias("first")).select(*keys, F.col("first.doc_id").alias("node"), F.col("first.chunk").alias("chunk"))
    classes = materialise(classes, "classes")
    sets = signed(chunks, classes.select("chunk", F.col("node").alias("doc_id")).distinct(), bits)
    tokens = materialise(sets.select(F.explode("tokens").alias("token"), "node").distinct(), "tokens")
    return rows, classes, sets, tokens


def components_of(chunks, with_links: bool = False) -> DataFrame:
    """(chunk, doc_id, n_shingles, component_id) for every row of the chunks, and n_links if asked for."""
    rows, classes, sets, tokens = prepared(chunks)
    keys = ["n_shingles", "f1", "f2"]
    links = all_links(tokens, sets) if with_links else tile_edges(tokens, sets, materialise(star_edges(tokens, sets), "links"))
    placed = materialise(rows.join(classes.drop("chunk"), keys, "left").select("chunk", "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "placed")
    several = placed.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").drop("high")
    same_id = placed.where("node is not null").join(several, "doc_id").select(F.col("node").alias("a"), F.col("low").alias("b"))
    of = components(links.unionByName(same_id))
    out = placed.join(of, "node", "left").select("chunk", "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"), "node")
    if not with_links:
        return out.drop("node")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    return out.join(ends, "node", "left").drop("node").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All links (a, b), a < b, between documents with similar but unequal sets; none is left out.

    Documents with equal sets are one class; its links are given once, for the smallest doc_id of the class. Rules are
    those of ``jaccard_components``. N near copies have up to N (N - 1) / 2 links, so the result can grow with the square of
    a group; use the components where groups are all that is needed.
    """
    _, _, sets, tokens = prepared(deal(docs, doc_id, text))
    return all_links(tokens, sets)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_links: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``with_links`` adds n_links, the number of links that the row's class has in ``jaccard_links``, at the cost of
    verifying them all.

    A-Z are lower-cased; a set holds the distinct runs of five words, or all words as one run if they are fewer. Null
    text and text without words have an empty set and link with nothing: their component is their own doc_id. Rows
    that share a doc_id count as one document. Rows with a null doc_id have a null component and link with nothing.
    Other columns are ignored. An empty table gives an empty result.
    """
    return components_of(deal(docs, doc_id, text), with_links).drop("chunk")


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest doc_id of each component, all columns as they are.

    Of rows that share its doc_id, the one with the smallest text stays (null before all). Rows with a null doc_id all
    stay.
    """
    others = tuple(c for c in docs.columns if c not in (doc_id, text))
    chunks = deal(docs, doc_id, text, carry=others)
    first = components_of(chunks).where("doc_id = component_id").select("chunk", "doc_id").distinct()
    names = ["doc_id", "text", *(f"carry_{i}" for i in range(len(others)))]

    def choose(chunk, table, given):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text")
        keep, held = set(given.column("doc_id").to_pylist()), {}
        for row, i in enumerate(ids):
            if i in keep and (i not in held or (texts[row].as_py() or "") < (texts[held[i]].as_py() or "")):
                held[i] = row
        stay = pa.array(sorted([*held.values(), *(row for row, i in enumerate(ids) if i is None)]), pa.int64())
        yield {c: table.column(c).take(stay) for c in names}

    out = restored(chunks.answered(first, choose, "doc_id long, text string" + carried(docs, others)), others)
    return out.withColumnsRenamed({"doc_id": doc_id, "text": text}).select(*docs.columns)
