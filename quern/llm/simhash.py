"""SimHash near-duplicates found with BK-trees.

A text's fingerprint has bit i set if over half of its word shingles' XXH64 hashes have it.
Fingerprints that differ in at most `radius` bits are linked, and linked documents form
groups. Steps:

1. Fingerprints per document in Arrow batches; equal fingerprints are merged before any
   search, so a group of copies is one node however large.
2. With radius r, two linked fingerprints agree in at least one of r + 1 bit blocks. Each
   (block, value) is a shard. A shard of over SHARD_ROWS fingerprints is cut again by the
   remaining bits in r + 1 blocks, and so on: complete at every level, so no cap is needed.
3. A BK-tree per shard (children keyed by their Hamming distance to the parent): each
   fingerprint follows only the edges whose key is within the radius of its own distance,
   then takes its place. Only links that join two sets are kept: a spanning forest, at most
   one link per fingerprint and shard.
4. Components of those links (components.py), joined back to the documents.

Shard trees are built where the shuffle brings their rows and are not broadcast whole: they
grow with the corpus, so there is no bound on their size that a broadcast would need.

Null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle. Rows with a null doc_id keep their row and never name a component
that has another member with an id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import buffer_of, configure, texts, written
from quern.llm.components import components

SEED = 42
BITS = 64
#: Fingerprints of one tree; beyond it a shard is cut by further bits.
SHARD_ROWS = 4096
#: Shingles whose bits are laid out at once (64 bytes each).
SHINGLES = 1 << 14


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each word shingle of a text (UTF-8), repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    hashed = xxhash.xxh64_intdigest
    found = [hashed(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())]
    return np.array(found, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set, as an unsigned integer."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), SHINGLES):
        part = hashes[k : k + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every document."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            body, at = data.tobytes(), offsets.tolist()
            found = np.fromiter((majority(shingle_hashes(body[a:b], width)) for a, b in zip(at, at[1:])), np.uint64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A metric tree of distinct 64-bit values under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of stored values within the radius."""
        if not self.values:
            return []
        found, todo = [], [0]
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for key, child in self.children[node].items():
                if -radius <= key - d <= radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        at = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while node != at:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), at)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join all values connected by steps within the radius, as positions."""
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, value in enumerate(values):
        for other in tree.near(value, radius):
            a, b = root(k), root(other)
            if a != b:
                parent[a] = b
                links.append((k, other))
        tree.add(value)
    return links


def _cut(rows: DataFrame, free: int, radius: int) -> tuple[DataFrame, int]:
    """rows (key, rest, fp) dealt to radius + 1 shards each, by blocks of the `free` lowest bits of rest; what stays free is moved to the low end."""
    blocks = radius + 1
    edges = [free * k // blocks for k in range(blocks + 1)]
    kept = max(free - (b - a) for a, b in zip(edges, edges[1:]))
    mask = lambda n: F.lit((1 << n) - 1 if n < 63 else (1 << 63) - 1 if n == 63 else -1)
    shards = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        value = F.shiftrightunsigned("rest", a).bitwiseAND(mask(b - a))
        low = F.col("rest").bitwiseAND(mask(a)) if a else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned("rest", b), a) if b < 64 else F.lit(0).cast("long")
        shards.append(F.struct(F.xxhash64("key", F.lit(k), value).alias("key"), low.bitwiseOR(high).alias("rest")))
    return rows.select(F.explode(F.array(*shards)).alias("s"), "fp").select("s.key", "s.rest", "fp"), kept


def links(prints: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) within the radius that connect all that are connected."""
    if not 0 <= radius < 16:
        raise ValueError("radius must be 0 to 15")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                found = forest([v & (2**64 - 1) for v in held], radius)
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([held[x] for x in a], pa.int64()), pa.array([held[x] for x in b], pa.int64())], ["a", "b"])

        for batch in batches:
            keys, values = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(bounds, bounds[1:]):
                if held and keys[lo] != held_key:
                    yield from closed()
                    held = []
                held_key = keys[lo]
                held.extend(values[lo:hi].tolist())
        yield from closed()

    def searched(rows: DataFrame) -> DataFrame:
        # A key is a 64-bit hash of (block, value): two shards that met under one key would only be searched together.
        return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")

    rows, free = _cut(prints.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp"), BITS, radius)
    found = []
    while True:
        rows = written(rows, "shards")
        hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select("key")
        hot = written(hot, "hot")
        if free <= radius + 1 or hot.isEmpty():
            found.append(searched(rows))
            break
        found.append(searched(rows.join(hot, "key", "left_anti")))
        rows, free = _cut(rows.join(hot, "key", "left_semi"), free, radius)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def grouped(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of every document."""
    prints = written(fingerprints(docs, width), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes, radius))
    member = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = written(member, "members")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, width: int = 5, radius: int = 3) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id (every row of that id). Rows without a doc_id can't be told apart by it and stay."""
    found = grouped(docs, width, radius).where("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
