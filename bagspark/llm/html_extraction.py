"""Main text of web pages by wrappers: one union-free expression per host, inferred from all of its pages.

Every page is parsed to a block tree whose repeats are folded (``html_tree``). Pages of a host mostly share a few such
shapes, so shapes are counted first, and only distinct ones are aligned: shapes of a host are dealt to about the square
root of their number of groups, each group is generalised to one expression, and these to the wrapper of the host. A mismatch makes
a part optional, a repeat a repeated group, differing texts a slot. What the slots hold on all pages of the host then
decides which are the article: where they stand, how much of them is links, and whether they ever change.

Page texts are moved at most once, to meet the decision on their shape; nothing is gathered per host but expressions and
one row of sums per slot.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagspark.llm.html_tree import generalised, packed, placed, slots, tree, unpacked
from bagspark.session import materialise

HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
LINKED = 0.5
COMMON = 0.8
PAGES = 3
REGION = 0.6
DROPPED, ARTICLE, MAIN, CONTENT, OTHER, REST = range(6)

# fixed values: elements, roles and class words of parts that are not the article
NOT_TEXT = frozenset("nav footer aside form button select option dialog noscript svg template menu legend search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER = frozenset(
    "comment comments commentlist disqus respond replies reply related recommended recommendations recirculation sponsored sponsor teaser teasers ad ads "
    "adv advert adverts advertisement advertising adsense promo promos promotion cookie cookies consent gdpr newsletter subscribe signup paywall "
    "share sharing social breadcrumb breadcrumbs pagination pager popup modal overlay footer footnav nav navbar navigation hidden".split()
)
AROUND = frozenset("header masthead sidebar side banner notice notices alert menu toolbar search widget widgets login skip tags topbar promobar".split())
ARTICLES = frozenset("article".split())
CONTENTS = frozenset("article post entry story content body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LAYOUT = re.compile(r"\b(?:has|with|no|without|is)-[\w-]+")


@lru_cache(100_000)
def marks(symbol: str) -> tuple[str, frozenset[str], frozenset[str], bool]:
    """(element, words of class and id, roles, hidden) of a symbol."""
    name, *more = symbol.split("|")
    given = dict(m.split("=", 1) for m in more if "=" in m)
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{given.get('class', '')} {given.get('id', '')}").lower()
    words = frozenset(re.findall("[a-z]+", LAYOUT.sub(" ", text)))
    return name, words, frozenset([*given.get("role", "").lower().split(), *given.get("itemprop", "").lower().split()]), "hidden" in more


@lru_cache(100_000)
def standing(path: tuple[str, ...]) -> int:
    """What the place of a slot says: inside an article, the main part, a part named like content, elsewhere, or in no text at all."""
    level, inner = OTHER, -1
    for k, (name, words, roles, _) in enumerate(map(marks, path)):
        if name == "article" or "articlebody" in roles:
            level, inner = ARTICLE, k
        elif (name == "main" or "main" in roles) and level != ARTICLE:
            level, inner = MAIN, k
    for k, (name, words, roles, hidden) in enumerate(map(marks, path)):
        if name in NOT_TEXT or hidden or roles & ROLES or words & NEVER or (name == "header" and level != ARTICLE):
            return DROPPED
        if k > inner and words & AROUND and not (level == ARTICLE and "header" in words):
            return DROPPED
        if level == OTHER and words & CONTENTS:
            level = CONTENT
    return level


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shape_key(shape: str) -> str:
    return hashlib.blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def parsed(batch: pa.RecordBatch) -> Iterator[tuple]:
    for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
        nodes, texts, links = tree(page or "")
        yield host, nodes, packed(nodes), texts, links


def observed(pages: DataFrame) -> DataFrame:
    """(host, key, place, shape, pages, chars, links, low, high): sums per slot of each shape; place -1 carries the shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list] = {}
            for host, nodes, shape, texts, links in parsed(batch):
                key = shape_key(shape)
                rows = [(-1, shape, 0, 0, 0)] + [
                    (k, None, sum(len(texts[t]) for t in n.texts), sum(links[t] for t in n.texts), digest("\n".join(texts[t] for t in n.texts)))
                    for k, (n, _, _) in enumerate(slots(nodes))
                ]
                for place, given, chars, linked, value in rows:
                    r = seen.setdefault((host, key, place), [given, 0, 0, 0, value, value])
                    r[1:] = r[1] + 1, r[2] + chars, r[3] + linked, min(r[4], value), max(r[5], value)
            if seen:
                columns = [*zip(*seen), *zip(*seen.values())]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["host", "key", "place", "shape", "pages", "chars", "links", "low", "high"])

    rows = pages.mapInArrow(run, "host string, key string, place int, shape string, pages long, chars long, links long, low long, high long")
    return rows.groupBy("host", "key", "place").agg(
        F.first("shape", ignorenulls=True).alias("shape"), *[F.sum(c).alias(c) for c in ("pages", "chars", "links")], F.min("low").alias("low"), F.max("high").alias("high")
    )


def merged(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, shape): the expressions of each group generalised to one. Groups stream by, one expression in memory at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in shapes.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper = None, []

        def done() -> pa.RecordBatch:
            values = [pa.array([v], batch_types[c]) for c, v in zip(keys, now)]
            return pa.RecordBatch.from_arrays([*values, pa.array([packed(wrapper)])], [*keys, "shape"])

        for batch in batches:
            batch_types = {c: batch.schema.field(c).type for c in keys}
            for *key, shape in zip(*(batch.column(c).to_pylist() for c in (*keys, "shape"))):
                if key != now:
                    if now is not None:
                        yield done()
                    now, wrapper = key, unpacked(shape)
                else:
                    wrapper = generalised(wrapper, unpacked(shape))
        if now is not None:
            yield done()

    dealt = shapes.select(*keys, "shape").repartition(*keys).sortWithinPartitions(*keys, "shape")
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", shape string")


def wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) from the (host, key, shape) of all pages."""
    most = shapes.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    groups = math.isqrt(max(most - 1, 0)) + 1
    first = merged(shapes.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")), ["host", "part"])
    return merged(first, ["host"]).withColumnRenamed("shape", "wrapper")


def slot_sums(shapes: DataFrame) -> DataFrame:
    """(host, slot, pages, chars, links, low, high) from rows (host, shape, wrapper, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list] = {}
            for host, shape, wrapper, stats in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "wrapper", "stats"))):
                for slot, s in zip(placed(unpacked(shape), unpacked(wrapper)), stats):
                    r = seen.setdefault((host, slot), [0, 0, 0, s["low"], s["high"]])
                    r[:] = r[0] + s["pages"], r[1] + s["chars"], r[2] + s["links"], min(r[3], s["low"]), max(r[4], s["high"])
            if seen:
                columns = [*zip(*seen), *zip(*seen.values())]
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["host", "slot", "pages", "chars", "links", "low", "high"])

    rows = shapes.mapInArrow(run, "host string, slot int, pages long, chars long, links long, low long, high long")
    return rows.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")], F.min("low").alias("low"), F.max("high").alias("high"))


def judged(wrapper: str, sums: list[dict]) -> list[int]:
    """A level for each slot of a host's wrapper: the lower, the surer it is the article; 0 for what is not.

    Besides its place, a slot is dropped if more than half of it is links, unless it is a heading, or if it holds one and the same text
    on nearly all pages of a host while others change. Slots without a telling place are ranked by the region with most text.
    """
    known = {s["slot"]: s for s in sums}
    host_pages = max((s["pages"] for s in sums), default=0)
    moving = any(s["low"] != s["high"] for s in sums)
    places = [(path, outside, known.get(k)) for k, (_, path, outside) in enumerate(slots(unpacked(wrapper)))]
    levels = []
    for path, outside, s in places:
        level = standing(path)
        if level and s and s["chars"]:
            heading = any(marks(p)[0] in HEADINGS for p in path[-1:])
            fixed = outside is None and s["low"] == s["high"] and moving and host_pages >= PAGES and s["pages"] >= COMMON * host_pages
            if fixed or (s["links"] > LINKED * s["chars"] and not heading):
                level = DROPPED
        levels.append(level)
    open_ = [(path, len(path) if outside is None else outside, s["chars"]) for level, (path, outside, s) in zip(levels, places) if level == OTHER and s]
    total, region = sum(c for _, _, c in open_), ()
    while total:
        inside: dict[tuple, int] = defaultdict(int)
        for path, single, chars in open_:
            if path[: len(region)] == region and single > len(region):
                inside[path[: len(region) + 1]] += chars
        best = max(inside, key=inside.get, default=None)
        if best is None or inside[best] < REGION * total or marks(best[-1])[0] in HEADINGS | {"p", "li", "pre", "td"}:
            break
        region = best
    return [REST if v == OTHER and path[: len(region)] != region else v for v, (path, _, _) in zip(levels, places)]


def decisions(observations: DataFrame) -> DataFrame:
    """(host, key, levels): a level for every slot of every shape."""
    slot = F.struct("place", "pages", "chars", "links", "low", "high")
    shapes = observations.groupBy("host", "key").agg(
        F.first("shape", ignorenulls=True).alias("shape"), F.sort_array(F.collect_list(F.when(F.col("place") >= 0, slot))).alias("stats")
    )
    shapes = materialise(shapes, "shapes")
    found = materialise(wrappers(shapes), "wrappers")
    together = shapes.join(found, "host")
    sums = slot_sums(together).groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "links", "low", "high")).alias("sums"))
    known = materialise(found.join(sums, "host", "left"), "judged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, []
        for batch in batches:
            out = []
            for host, shape, wrapper, sums in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "wrapper", "sums"))):
                if host != now:
                    now, levels = host, judged(wrapper, sums or [])
                page = unpacked(shape)
                own = [standing(path) for _, path, _ in slots(page)]
                out.append([levels[s] if s >= 0 else v for s, v in zip(placed(page, unpacked(wrapper)), own)])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["host", "key", "levels"])

    return shapes.select("host", "key", "shape").join(known, "host").mapInArrow(run, "host string, key string, levels array<int>")


def blocks(pages: DataFrame, kept: list[str]) -> DataFrame:
    """(*kept, host, key, texts, places): the texts of each page that may be the article, with their slot in its shape."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, all_texts, all_places = [], [], []
            for _, nodes, shape, texts, _ in parsed(batch):
                place = {t: k for k, (n, path, _) in enumerate(slots(nodes)) if standing(path) for t in n.texts}
                keys.append(shape_key(shape))
                all_texts.append([texts[t] for t in sorted(place)])
                all_places.append([place[t] for t in sorted(place)])
            columns = [*(batch.column(c) for c in (*kept, "host")), pa.array(keys, pa.string()), pa.array(all_texts, pa.list_(pa.string())), pa.array(all_places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "host", "key", "texts", "places"])

    return pages.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*kept, "host")) + ", key string, texts array<string>, places array<int>")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, one row per row of ``pages``.

    Of the texts of a page those of its surest level are kept, in page order, joined by one space. Null or empty html and pages
    without main text give the empty string. Pages without a url, or with one that has no host, count as one host. Rows
    that repeat are extracted each; other columns are ignored. Broken markup is read tolerantly, characters outside any element are text.
    """
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    decided = materialise(decisions(materialise(observed(given.select("host", "html")), "observed")), "decisions")
    level = F.transform("places", lambda p: F.get("levels", p))
    read = blocks(given, ["page_id", "url"]).join(decided, ["host", "key"], "left").select("page_id", "url", "texts", level.alias("level"))
    surest = read.withColumn("surest", F.array_min(F.filter("level", lambda v: v > 0)))
    text = F.array_join(F.filter("texts", lambda _, k: F.get("level", k) == F.col("surest")), " ")
    return surest.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
