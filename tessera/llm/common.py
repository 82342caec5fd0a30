"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import shared_dir


SLICE_BYTES, BATCH_ROWS = 4 << 20, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Memo tables that outlive a task in their worker process.
_KEPT: list = []


def kept_in_worker(make):
    """``make``, called once for each worker process: its result serves many tasks, until a task of another kind frees it."""
    cached = lru_cache(1)(make)
    _KEPT.append(cached)
    return cached


def release(keep=None) -> None:
    """At the start of a task: frees what tasks of other kinds have left in this worker."""
    for cached in _KEPT:
        if cached is not keep:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes, so that Python never holds all its texts as objects."""
    rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def bounded(df: DataFrame) -> DataFrame:
    """Smaller Arrow batches than Spark's 10000 rows, which are many MB where rows are texts; a setting of the user's stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def loose(kind: T.DataType) -> T.DataType:
    """The type with every part nullable, as the results of Python functions are declared."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, loose(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(loose(kind.elementType))
    return T.MapType(loose(kind.keyType), loose(kind.valueType)) if isinstance(kind, T.MapType) else kind


def _loose(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _loose(f.type), True, f.metadata) for f in kind.fields])
    if pa.types.is_map(kind):
        return pa.map_(_loose(kind.key_type), _loose(kind.item_type))
    return pa.list_(_loose(kind.value_type)) if pa.types.is_list(kind) else kind


def returned(df: DataFrame, names: Iterable[str], more: str) -> T.StructType:
    """Schema of a Python function's result: columns of ``df`` and then ``more``."""
    return T.StructType([*(T.StructField(n, loose(df.schema[n].dataType)) for n in names), *T.StructType.fromDDL(more).fields])


def relaxed(column):
    """An Arrow column with every part nullable."""
    kind = _loose(column.type)
    return column if kind == column.type else column.cast(kind)


def named(column: str) -> Column:
    """A top-level column, whatever its name."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame, **more) -> DataFrame:
    """All columns as one struct, ``row``, so that they clash with no name of an operator; ``more`` beside it."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("row"), *[v.alias(k) for k, v in more.items()])


def unpacked(rows: DataFrame, like: DataFrame, **new) -> DataFrame:
    """The columns of ``like`` from ``row``, some of them given anew."""
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in like.columns])


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], keep=None) -> DataFrame:
    """``make`` runs once per task; what it returns handles one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        handle = make()
        for batch in batches:
            for part in slices(batch):
                for found in handle(part):
                    yield pa.RecordBatch.from_arrays([relaxed(c) for c in found.columns], names=found.schema.names)

    return bounded(df).mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def pieces(spark: SparkSession, df: DataFrame, size: str, each: int, least: int = 1) -> int:
    """How many groups of about ``each`` units hold what the expression ``size`` sums to."""
    total = df.agg(F.sum(F.expr(size)).alias("n")).first()["n"] or 0
    return max(least, -(-int(total) // each))


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def worker_cache_limit() -> int:
    """Entries that a worker's memo table may hold before it is emptied."""
    return int(os.environ.get("TESSERA_CACHE_ENTRIES", "700000"))


#: Bytes of a text whose words are hashed at a time.
SPAN = 1 << 20
ODD = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    up = np.cumprod(np.full(SPAN + 1, ODD, np.uint64))
    return up, np.cumprod(np.full(SPAN + 1, pow(ODD, -1, 1 << 64), np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word (run without a blank), all words of a span at once: differences of the prefix sums of a polynomial."""
    out, at = [], 0
    up, down = _powers()
    while at < len(text):
        stop = len(text) if len(text) - at <= SPAN else text.rfind(b" ", at, at + SPAN)
        if stop < at:  # a word that is longer than a span
            stop = len(text) if (stop := text.find(b" ", at)) < 0 else stop
            out.append(np.array([xxhash.xxh64_intdigest(text[at:stop])], np.uint64))
        else:
            data = np.frombuffer(text[at:stop], np.uint8)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[: len(data)])])
            edges = np.flatnonzero(np.diff(data != 0x20, prepend=False, append=False))
            out.append(mixed((sums[edges[1::2]] - sums[edges[::2]]) * down[edges[::2]]))
        at = stop + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
