"""Reading tables and mapping Arrow batches, shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 32 << 20
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators read; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_held: dict[tuple, object] = {}


def start_empty() -> None:
    """For a task that needs the memory: tables that other operators left in its Python worker go."""
    _held.clear()
    hand_back()


def hand_back() -> None:
    """Give freed memory back to the system: numpy's and Arrow's allocators keep it, for as long as a Python worker lives, and other stages can't use it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hold(operator: str, key, make: Callable[[], object]):
    """Tables of an operator, made once in a Python worker and kept from task to task.

    Workers live through all stages, so those of another operator go before new ones are made.
    """
    if (operator, key) not in _held:
        start_empty()
        _held[operator, key] = make()
    return _held[operator, key]


def held(operator: str, key):
    """What :func:`hold` keeps, or nothing."""
    return _held.get((operator, key))


def map_arrow(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, done: Callable[[], None] | None = None
) -> DataFrame:
    """``mapInArrow`` over single batches; ``done`` ends a task, since Python workers live on and would keep what they hold.

    What tasks before it left, of whatever operator, goes back when a task begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from work(batch)
        finally:
            if done is not None:
                done()
            hand_back()

    return df.mapInArrow(run, schema)


def held_out(doc_id):
    """True for the rows labels are never learnt from: CRC-32 of the id as text is divisible by ``FOLDS``."""
    return fold(doc_id) == 0


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fold_of(doc_id) -> int:
    """Python twin of :func:`fold`."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % FOLDS


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """``(doc_id, label)`` with one label per document: the more frequent one where rows contradict each other, 1 where both are as frequent."""
    return labels.groupBy("doc_id").agg((F.avg(F.col(name).cast("double")) >= 0.5).cast("int").alias(name))


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted size is below ``BROADCAST_BYTES``; else Spark shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def bounded_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most about ``rows`` rows, chosen by a hash of the id; all of them where there are no more than that."""
    n = labelled.count()
    if n <= rows:
        return labelled
    share = math.floor(rows / n * 1_000_000)
    return labelled.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) < share)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, their first bytes together, then their second ones and so on; small numbers cost little."""
    width = numbers.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width).T).tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(raw: bytes, kind) -> np.ndarray:
    """What :func:`pack` was given."""
    size, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(raw[8:], size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)
