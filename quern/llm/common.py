"""Helpers that the training-data operators share.

Texts travel as Arrow batches and are worked on as one byte buffer with offsets, cut into
pieces of about PIECE_BYTES so that numpy temporaries stay small whatever a batch holds.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # glibc's own call for it; other C libraries return memory in their own ways
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None

PIECE_BYTES = 1 << 18

#: Rows that Spark hands to Python at once. Rows are whole documents here, so the default
#: of 10,000 would make batches of tens of MB on each side of the socket.
ARROW_ROWS = 1000


def configure(spark: SparkSession) -> None:
    """Hands whole documents to Python in smaller batches (a runtime setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none and is a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quern-checkpoints-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read any more."""
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(f) for f in df.inputFiles() if "/quern-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Hands freed memory back to the system: workers live on between tasks and stages, beside a JVM that needs the room."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (and more columns) alone, whatever other columns a table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their whole names, which may have dots in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def undotted(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with plain names for columns whose names have dots, which functions over Arrow batches take for paths; and what redotted() needs."""
    plain = {c: f"__dotted_{k}" for k, c in enumerate(docs.columns) if "." in c}
    if not plain:
        return docs, {}
    return docs.select(*[x.alias(plain.get(c, c)) for c, x in zip(docs.columns, named(docs.columns))]), {v: k for k, v in plain.items()}


def redotted(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """docs with the names that undotted() took away."""
    return docs.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns]) if names else docs


_OWN = "__own_"


def aside(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """docs with its columns of those names renamed, so that an operator can give such columns of its own; back() undoes it."""
    taken = set(names)
    return docs.select(*[x.alias(_OWN + c if c in taken else c) for c, x in zip(docs.columns, named(docs.columns))])


def back(docs: DataFrame, columns: Sequence[str], names: Iterable[str]) -> DataFrame:
    """The columns that docs had before aside()."""
    taken = set(names)
    return docs.select(*[x.alias(c) for c, x in zip(columns, named(_OWN + c if c in taken else c for c in columns))])


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes together; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in (rows may be empty)."""
    return np.searchsorted(offsets, starts, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e]: a polynomial of its bytes modulo 2^64, scrambled with its length."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes of a word in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of a word in `[^\x20\x09-\x0D]+`.
DARK = np.ones(256, bool)
DARK[0x20] = DARK[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of that kind; a run ends where its row ends."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = cut[inside[cut] & inside[cut + 1]]
    first[joined] = last[joined] = True
    return np.flatnonzero(first), np.flatnonzero(last)
