"""Documents in chunks, and round trips between chunks and shards of a hash space.

Questions about the whole corpus ("how often does this run of words occur?") are asked by every chunk at
once: a chunk sends each shard one packed value for all its keys there, the shard answers with one packed
value per chunk. So a key that fills a third of the corpus is one entry per chunk and lands nowhere in bulk.
Texts are dealt to chunks once, into a bucketed table; later passes read a chunk where it lies, and only
packed keys and answers are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.session import scratch_path

CHUNK_BYTES = 8 << 20
LARGEST_CHUNK = 256 << 20
MAX_BUCKETS = 50_000
SENT = "shard int, chunk int, keys binary, extra binary"
ANSWER = "chunk int, shard int, answer binary"


@dataclass
class Chunks:
    """A bucketed table (chunk, doc_id, text, carried columns), the number of chunks and of bytes of text."""

    table: DataFrame
    n: int
    bytes: int

    def send(self, kernel: Callable, schema: str = SENT) -> DataFrame:
        """One call of ``kernel(chunk, table)`` per chunk, which yields Arrow tables."""

        def run(key, table):
            return collected(kernel(key[0].as_py(), table), schema)

        return self.table.groupBy("chunk").applyInArrow(run, schema)

    def answered(self, answers: DataFrame, kernel: Callable, schema: str) -> DataFrame:
        """One call of ``kernel(chunk, table, answers)`` per chunk with the rows that were sent to it."""

        def run(key, table, answers):
            return collected(kernel(key[0].as_py(), table, answers), schema)

        return self.table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def collected(parts: Iterable[dict], schema: str) -> pa.Table:
    """Columns given as arrays, one dict per part, as one table."""
    fields = [field.strip().split(" ", 1) for field in schema.split(",")]
    tables = [pa.table({name: typed(part[name], kind) for name, kind in fields}) for part in parts]
    return pa.concat_tables(tables) if tables else pa.table({name: pa.array([], KINDS[kind]) for name, kind in fields})


def typed(values, kind: str) -> pa.Array | pa.ChunkedArray:
    if not isinstance(values, (pa.Array, pa.ChunkedArray)):
        return pa.array(values, KINDS[kind])
    return values.cast(KINDS[kind]) if kind in KINDS else values


KINDS = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32(), "binary": pa.binary(),
         "string": pa.string(), "boolean": pa.bool_()}


def carried(docs: DataFrame, columns: Iterable[str]) -> str:
    """The schema text of carried columns, named by place so that no name can clash."""
    return "".join(f", carry_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))


def restored(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The carried columns under their own names."""
    columns = list(columns)
    return df.select(*[c for c in df.columns if not c.startswith("carry_")], *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(columns)])


def deal(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Iterable[str] = ()) -> Chunks:
    """Deals rows to chunks by a hash of their key: (chunk, doc_id, text) and the columns named in ``carry``.

    Rows with a null key are dealt by their text. The number of chunks follows the bytes of all texts. The
    bucketed table lies in the shared folder; executors that are lost later re-read it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = max(1, -(-size // max(CHUNK_BYTES, min(LARGEST_CHUNK, size // 4096))))
    place = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text))), F.lit(n)).cast("int")
    rows = docs.select(
        place.alias("chunk"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    )
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = min(n, MAX_BUCKETS)
    rows.repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").sortBy("chunk").format("parquet").option(
        "path", scratch_path(spark, "chunks")
    ).saveAsTable(name)
    return Chunks(spark.table(name), n, int(size))


def merge(sent: DataFrame, kernel: Callable, schema: str = ANSWER) -> DataFrame:
    """One call of ``kernel(shard, table)`` per shard; the answers are written, as several passes read them."""

    def run(key, table):
        return collected(kernel(key[0].as_py(), table), schema)

    return sent.groupBy("shard").applyInArrow(run, schema)
