"""Near copies: texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more, all of them.

1. A text's shingles are a set of 64-bit hashes; equal sets are one node, however many texts.
2. SimHash (simhash.py) over the same shingles: fingerprints within RADIUS bits are found with BK-trees,
   equal ones meet at one of their nodes. Those links are tested exactly; the ones that hold make first groups.
3. Copies at 0.8 differ in some ten bits, too many to search for, so what lies beyond RADIUS is found by prefixes. In any order of all shingles, two sets that alike share one of the first
   n - ceil(0.8 n) + 1 shingles of each (prefix filter). The order here is by hash, with
   shingles that a sample shows to be common last. Only shingles that two nodes have in
   their prefix are looked at.
4. Nodes of different groups that meet under a shingle are compared by their sketches: bit h mod B is the parity of
   the number of shingles there, so two sets differ in at least as many shingles as their
   sketches in bits. What is too far by that can't be near. Of the other pairs a spanning forest
   is kept.
5. Links of the forest are tested exactly, too. A component of candidates whose links all hold is
   one group. In the others all pairs that sketches allow are tested, exactly.

Null and empty texts have the empty set and are one node. Fewer words than five make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import buffer_of, configure, release_memory, texts, written
from quern.llm.components import components
from quern.llm.simhash import shingle_hashes

WIDTH, RADIUS = 5, 3
#: One text of SAMPLE is looked at for common shingles; one found COMMON times there goes last. Speed alone depends on them.
SAMPLE, COMMON, MOST_COMMON = 16, 64, 100_000


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard likeness of two sorted sets is at least 0.8."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    n = len(found) - (4 * len(found) + 4) // 5 + 1 if len(found) else 0
    last = np.isin(found, common) if len(common) else np.zeros(len(found), bool)
    return np.concatenate([found[~last], found[last]])[:n]


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their lowest bits, at least as many bits as shingles (a power of two, from 64)."""
    size = max(64, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray) -> np.ndarray:
    """The sketch of half as many bits."""
    half = len(words) // 2
    return words[:half] ^ words[half:]


def forest(sizes: np.ndarray, sketches: list[np.ndarray], test=None, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets connected by pairs that their sketches (and the test, if any) allow, as positions. Sets of one group (numbers) count as joined."""
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    sketches = [sketches[k] for k in order.tolist()]
    width = np.array([len(x) for x in sketches])
    stacks = {w: (lo := int(np.searchsorted(width, w)), np.stack(sketches[lo : int(np.searchsorted(width, w, "right"))])) for w in np.unique(width).tolist()}
    label, links = np.arange(len(sizes)) if groups is None else groups[order], []
    least = np.searchsorted(5 * sizes, 4 * sizes)
    for i in range(1, len(sizes)):
        lo, mine, near, far = int(least[i]), sketches[i], [], []
        if lo == i:
            continue
        # Sizes differ by a quarter at most, so widths are the same or halved once.
        for w, own in ((len(mine), mine), (len(mine) // 2, None)):
            if w not in stacks:
                continue
            first, stack = stacks[w]
            a, b = max(lo, first), min(i, first + len(stack))
            if a < b:
                d = np.bitwise_count(stack[a - first : b - first] ^ (own if own is not None else folded(mine))).sum(axis=1, dtype=np.int64)
                at = np.flatnonzero(9 * d <= sizes[i] + sizes[a:b])
                near.append(at + a)
                far.append(d[at])
        if not near:
            continue
        near = np.concatenate(near)[np.argsort(np.concatenate(far), kind="stable")]
        while len(near):
            near = near[label[near] != label[i]]
            if not len(near):
                break
            j = int(near[0])
            if test is None or test(int(order[i]), int(order[j])):
                label[label == label[j]] = label[i]
                links.append((int(order[i]), int(order[j])))
            near = near[1:]
    return links


def _hashes(batch: pa.RecordBatch) -> list[np.ndarray]:
    data, offsets = buffer_of(batch.column("text"))
    body, at = data.tobytes(), offsets.tolist()
    return [shingle_hashes(body[a:b], WIDTH) for a, b in zip(at, at[1:])]


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.unique(x) for x in _hashes(batch)]


def _name(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def _common(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _sets(batch):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])
        release_memory()

    some = texts(docs).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])
    keys = some.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r.key for r in keys.orderBy(F.desc("n"), "key").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))


def _near(rows: DataFrame) -> DataFrame:
    """(a, b): a forest of the pairs of nodes under each key (columns key, node, size, sketch, root) that sketches allow; nodes of one root are joined already."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, names, sizes, sketches, roots = None, [], [], [], []
        a, b = [], []

        def close() -> None:
            if len(names) > 1:
                for x, y in forest(np.array(sizes, np.int64), sketches, groups=np.unique(np.array(roots, np.int64), return_inverse=True)[1]):
                    a.append(names[x])
                    b.append(names[y])

        for batch in batches:
            for key, node, size, body, root in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "size", "sketch", "root"))):
                if key != held_key:
                    close()
                    held_key, names, sizes, sketches, roots = key, [], [], [], []
                names.append(node)
                sizes.append(size)
                sketches.append(np.frombuffer(body, "<u8"))
                roots.append(root)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release_memory()

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(search, "a long, b long")


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])
    release_memory()


def _all_pairs(rows: pa.Table) -> pa.Table:
    names, found = rows.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in rows.column("found").to_pylist()]
    links = forest(np.array([len(x) for x in found], np.int64), [sketch(x) for x in found], lambda x, y: alike(found[x], found[y]))
    return pa.table([pa.array([names[x] for x, _ in links], pa.int64()), pa.array([names[y] for _, y in links], pa.int64())], names=["a", "b"])


def _sets_of(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(node, found): the shingle sets of the nodes in links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _sets(batch)
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "found"])
        release_memory()

    ends = written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), "ends")
    sets = texts(docs).mapInArrow(run, "node long, found binary").join(ends, "node", "left_semi")
    return written(sets.groupBy("node").agg(F.first("found").alias("found")), "sets")


def _test(links: DataFrame, sets: DataFrame) -> DataFrame:
    """links (a, b) with what the exact test says (good)."""
    both = links.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(_tested, "a long, b long, good boolean"), "tested")


def by_simhash(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b): links of nodes whose SimHash fingerprints (prints: node, fp) are within RADIUS bits and which are near copies by the exact test."""
    hubs = written(prints.groupBy("fp").agg(F.min("node").alias("hub")), "hubs")
    near = simhash.links(hubs.select("fp"), RADIUS).distinct()
    end = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}"))
    across = near.join(end("a"), "a").join(end("b"), "b").select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b"))
    within = prints.select("fp", "node").join(hubs, "fp").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = written(across.union(within).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near_prints")
    return _test(links, _sets_of(docs, links)).where("good").select("a", "b")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over near copies, itself included) of every document."""
    spark = docs.sparkSession
    configure(spark)
    common = spark.sparkContext.broadcast(_common(docs))

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _hashes(batch)
            prints = np.array([simhash.majority(x) for x in hashes], np.uint64).view(np.int64)
            found = [np.unique(x) for x in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([_name(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x).tobytes() for x in found], pa.binary()), pa.array([prefix(x, common.value).view(np.int64) for x in found], pa.list_(pa.int64())), pa.array(prints)],
                ["doc_id", "node", "size", "sketch", "keys", "fp"],
            )
        release_memory()

    prints = written(texts(docs).mapInArrow(prints_of, "doc_id long, node long, size long, sketch binary, keys array<long>, fp long"), "prints")
    sure = by_simhash(docs, prints.select("node", "fp"))
    joined = written(components(sure), "joined")
    keys = prints.select(F.explode("keys").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    rows = keys.join(written(shared, "shared"), "key", "left_semi").distinct()
    nodes = prints.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = written(_near(rows.join(nodes, "node").select("key", "node", "size", "sketch", "root")).distinct(), "links")

    candidates = links.union(sure)
    sets = _sets_of(docs, candidates)
    tested = _test(links, sets)
    good, bad = tested.where("good").select("a", "b").union(sure), tested.where("not good")
    if not bad.isEmpty():
        reach = written(components(candidates), "reach")
        mixed = reach.join(bad.select(F.col("a").alias("node")), "node", "left_semi").select("root").distinct()
        inside = reach.join(mixed, "root", "left_semi").join(sets, "node").select("root", "node", "found")
        good = good.union(inside.groupBy("root").applyInArrow(_all_pairs, "a long, b long"))

    first = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    member = first.join(components(good).withColumnRenamed("node", "end"), F.col("node") == F.col("end"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    member = written(member, "members")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "node").join(member.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest doc_id (every row of that id). Rows without a doc_id can't be told apart by it and stay."""
    found = grouped(docs).where("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
