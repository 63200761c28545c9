"""Vector code compression: product codes by Lloyd rounds in whole numbers, with heaps of slack.

Vectors become integers floor(scale * x) and are cut into equal parts; each part position has a
codebook. A round assigns every part to its nearest entry and moves each entry to the mean of its
parts, rounded down. Distances are exact integers, ties go to the lower index.

Vectors lie in blocks of bounded size, a row of a table each. A block keeps, per part position and
entry, a heap of the parts assigned to that entry, keyed by slack: a lower bound of the distance to
any other entry minus the distance to its own. An entry that moves by m while the others move by
at most M can use up m + M of it, so every entry has a running total of such drift, a part's key is
its slack plus the total at the time it was measured, and a part can only have changed hands if its
key is not above the total now. A round pops just those from the heaps, rescans them exactly
against the whole codebook and pushes them with new keys; the rest are not looked at. Bounds are
rounded so that they never promise too much. Blocks hand over what moved as sums and counts,
which Spark adds up; the driver sees one codebook's worth of them. After each round the blocks are a
table in the shared folder, so a lost executor costs a task of one round.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are
dropped, and so are those of another length than the kept vector with the least id. A length that
the parts don't divide is filled up with zeros. Components are held within plus or minus
sqrt(2^62 / length) / 2 (32,768.0 for 64 of them) so that errors are exact longs. The first codebook
comes from the first rows by (id, vector), nulls last; fewer rows than entries make a smaller
codebook. Repeated rows count each. Null ids and labels are kept. Empty table: no rows. Columns
besides id, vector and label, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.llm.common import configure, forget, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Components that a block holds at most.
BLOCK_VALUES = 1 << 18
#: Bytes of rows that Spark hands to Python at once: a row is a block here.
BATCH_BYTES = 1 << 26

#: Keys are slack in this fraction of a unit, above the place of a part in its block.
FINE, PLACE_BITS = 256, 18
MOST_SLACK = 1 << 42


@dataclass
class Codebooks:
    """entries[part][entry][position]; drift[part][entry]: the running total; sums and counts of the parts assigned to each entry."""

    entries: np.ndarray
    drift: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray, parts: int) -> Codebooks:
        entries = first.reshape(len(first), parts, -1).swapaxes(0, 1).copy()
        shape = entries.shape
        return cls(entries, np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))

    def moved(self, delta: np.ndarray) -> Codebooks:
        """After a round: delta holds the change of sums and, last, of counts for each part position and entry."""
        sums, counts = self.sums + delta[..., :-1], self.counts + delta[..., -1]
        means = np.floor_divide(sums, np.maximum(counts, 1)[..., None])
        entries = np.where(counts[..., None] > 0, means, self.entries)
        step = np.ceil(FINE * np.sqrt(((entries - self.entries) ** 2).sum(-1).astype(float)) * (1 + 1e-12)).astype(np.int64)
        others = np.zeros_like(step)
        for e in range(step.shape[1]):
            others[:, e] = np.delete(step, e, 1).max(1, initial=0)
        return Codebooks(entries, self.drift + step + others, sums, counts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Block:
    """Vectors of a block with their codes and heaps."""

    def __init__(self, values: np.ndarray, codes: np.ndarray, heaps: list[list[list[int]]]) -> None:
        self.values, self.codes, self.heaps = values, codes, heaps  # (parts, n, width), (parts, n), [part][entry]

    @classmethod
    def fresh(cls, values: np.ndarray, parts: int, entries: int) -> Block:
        """No part is assigned yet."""
        n = len(values)
        return cls(np.ascontiguousarray(values.reshape(n, parts, -1).swapaxes(0, 1)), np.full((parts, n), -1, np.int16), [[[] for _ in range(entries)] for _ in range(parts)])

    def advance(self, books: Codebooks) -> np.ndarray:
        """Assigns what drift may have moved, and returns the change of sums and counts by part position and entry."""
        parts, entries, width = books.entries.shape
        delta = np.zeros((parts, entries, width + 1), np.int64)
        for p in range(parts):
            stale = np.flatnonzero(self.codes[p] < 0).tolist()
            for e, heap in enumerate(self.heaps[p]):
                limit = int(books.drift[p, e])
                while heap and heap[0] >> PLACE_BITS <= limit:
                    stale.append(heapq.heappop(heap) & ((1 << PLACE_BITS) - 1))
            if stale:
                self._rescan(p, np.array(stale), books, delta[p])
        return delta

    def _rescan(self, p: int, places: np.ndarray, books: Codebooks, delta: np.ndarray) -> None:
        x, entries = self.values[p][places].astype(np.int64), books.entries[p]
        far = np.stack([((x - c) ** 2).sum(1) for c in entries], 1)
        new, old = far.argmin(1), self.codes[p][places]
        rows = np.arange(len(x))
        near = far[rows, new].astype(float)
        if len(entries) > 1:
            far[rows, new] = np.iinfo(np.int64).max
            second = far.min(1).astype(float)
            slack = np.floor(FINE * (np.sqrt(second) * (1 - 1e-12) - np.sqrt(near) * (1 + 1e-12))).astype(np.int64)
        else:
            slack = np.full(len(x), MOST_SLACK)
        went = new != old
        whole = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
        np.add.at(delta, new[went], whole[went])
        left = went & (old >= 0)
        np.subtract.at(delta, old[left], whole[left])
        self.codes[p][places] = new
        keys = ((slack + books.drift[p][new]) << PLACE_BITS) | places
        for e in np.unique(new):
            heap, more = self.heaps[p][e], keys[new == e].tolist()
            if len(more) * 8 > len(heap):
                heap.extend(more)
                heapq.heapify(heap)
            else:
                for key in more:
                    heapq.heappush(heap, key)

    def errors(self, books: Codebooks) -> np.ndarray:
        total = np.zeros(self.values.shape[1], np.int64)
        for p, codes in enumerate(self.codes):
            total += ((self.values[p].astype(np.int64) - books.entries[p][codes]) ** 2).sum(1)
        return total

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Values (in two, four or eight bytes each, told by their length), codes, heaps one after another and their lengths."""
        low, high = (int(self.values.min()), int(self.values.max())) if self.values.size else (0, 0)
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        flat = [heap for part in self.heaps for heap in part]
        keys = np.array([k for heap in flat for k in heap], np.int64)
        return self.values.astype(kind).tobytes(), self.codes.astype(np.int16).tobytes(), keys.tobytes(), np.array(list(map(len, flat)), np.int32).tobytes()

    @classmethod
    def unpacked(cls, n: int, values: bytes, codes: bytes, keys: bytes, lengths: bytes, shape: tuple[int, int, int]) -> Block:
        parts, entries, width = shape
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(values) // max(1, n * parts * width)]
        held, ends = np.frombuffer(keys, np.int64).tolist(), np.cumsum(np.frombuffer(lengths, np.int32)).tolist()
        flat = [held[a:b] for a, b in zip([0, *ends], ends)]
        return cls(np.frombuffer(values, kind).reshape(parts, n, width), np.frombuffer(codes, np.int16).reshape(parts, n).copy(), [flat[p * entries : (p + 1) * entries] for p in range(parts)])


def kept(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that are coded, but for the length of the vector."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def whole_numbers(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) within bounds, filled up to a multiple of parts."""
    limit = int((2**62 / vectors.shape[1]) ** 0.5) // 2
    found = np.clip(np.floor(vectors * scale), -limit, limit).astype(np.int64)
    return np.pad(found, ((0, 0), (0, -vectors.shape[1] % parts)))


def _rows(n_rows: pa.RecordBatch | pa.Table, length: int) -> np.ndarray:
    column = n_rows.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _state_schema(rows: DataFrame) -> StructType:
    ids, labels = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    return StructType.fromDDL(f"n int, ids array<{ids}>, labels array<{labels}>, of_values binary, codes binary, heap_keys binary, heap_lengths binary, delta array<long>")


def _state_row(block: Block, ids: pa.Array, labels: pa.Array, delta: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    columns = [pa.array([len(ids)], pa.int32()), one(ids), one(labels), *[pa.array([b], pa.binary()) for b in block.packed()], one(pa.array(delta.ravel()))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, values, codes, keys, lengths = (batch.column(c)[i].as_py() for c in ("n", "of_values", "codes", "heap_keys", "heap_lengths"))
            yield batch, i, Block.unpacked(n, values, codes, keys, lengths, shape)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _first_round(rows: DataFrame, books: Codebooks, length: int, parts: int, scale: int) -> DataFrame:
    """Blocks as the rows lie, every part assigned by a full scan."""
    schema = _state_schema(rows)
    size = max(1, min(BLOCK_VALUES // length, 1 << PLACE_BITS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)

        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            for at in range(0, table.num_rows, size):
                cut = table.slice(at, size).combine_chunks()
                own = Block.fresh(whole_numbers(_rows(cut, length), parts, scale), parts, books.entries.shape[1])
                delta = own.advance(books)
                flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (cut.column("vec_id"), cut.column("label"))]
                yield _state_row(own, *flat, delta, out)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield from block(held)
                held, n = [], 0
        if n:
            yield from block(held)

    return rows.mapInArrow(work, schema)


def _next_round(state: DataFrame, books: Codebooks) -> DataFrame:
    schema = state.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)
        for batch, i, block in _blocks(batches, books.entries.shape):
            delta = block.advance(books)
            yield _state_row(block, batch.column("ids")[i].values, batch.column("labels")[i].values, delta, out)

    return state.mapInArrow(work, schema)


def _coded(state: DataFrame, books: Codebooks, rows: DataFrame) -> DataFrame:
    """The last assignment: vec_id, label, code, error."""
    schema = StructType([StructField("vec_id", rows.schema["vec_id"].dataType), StructField("label", rows.schema["label"].dataType), *StructType.fromDDL("code string, error long").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)
        for batch, i, block in _blocks(batches, books.entries.shape):
            block.advance(books)
            text, wide = block.codes.T.astype(np.uint8).tobytes().hex(), 2 * len(block.codes)
            codes = [text[k : k + wide] for k in range(0, len(text), wide)]
            columns = [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(codes, pa.string()), pa.array(block.errors(books))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return state.mapInArrow(work, schema)


def _total(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Deltas of all blocks added up: as many rows as a codebook has numbers."""
    parts, entries, width = shape
    delta = np.zeros(parts * entries * (width + 1), np.int64)
    for place, total in state.select(F.posexplode("delta").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("total")).collect():
        delta[place] = total
    return delta.reshape(parts, entries, width + 1)


def trained(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks; entries at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits")
    spark = vectors.sparkSession
    _configure(spark)
    rows = kept(vectors, vec_id, vector, label)
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    length = len(first[0].vector)
    rows = rows.where(F.size("vector") == length)
    if any(len(r.vector) != length for r in first):
        first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    books = Codebooks.of(whole_numbers(np.array([r.vector for r in first]), parts, scale), parts)
    state = written(_first_round(rows, books, length, parts, scale), "blocks")
    for done in range(rounds):
        books = books.moved(_total(state, books.entries.shape))
        if done + 1 < rounds:
            before, state = state, written(_next_round(state, books), "blocks")
            forget(spark, before)
    if not rounds:
        return written(_coded(state, books, rows), "codes"), books
    coded = written(_coded(state, books, rows), "codes")
    forget(spark, state)
    return coded, books


def _configure(spark: SparkSession) -> None:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over equal labels, nulls together. Sums are added up before the join, and broadcast only if their table is under Spark's own limit; a label that a third of all rows have is split by adaptive execution otherwise."""
    sums = written(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
