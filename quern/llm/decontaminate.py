"""Benchmark decontamination with suffix arrays over the training text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A benchmark window is
`window` consecutive words of an item, or the whole of an item that has fewer. Each shard (a
piece of a document batch) gets a suffix array of its words: suffixes whose first two words
open no test suffix can't match and are left out, the others are sorted by their first
`window` words. Every test suffix is then binary-searched in every shard; the range found is
all its verbatim occurrences, and neighbouring occurrences chain into longest matches.

Words are numbered by 64-bit hashes of the benchmark vocabulary; each occurrence is compared
with the window's own bytes before it counts.

The benchmark is broadcast in blocks, one pass over the documents per block: a block's items
are drawn to the driver one after another, the arrays made of them (some OBJECT_SHARE bytes for
each byte of text) hold at most about OBJECT_BYTES, and a block that has done its work is
destroyed. Where there are several, each writes what it has found for the texts it hits, and these
finds are joined to the documents once, at the end. A text too long for a block goes in parts that overlap by a window less a word, so
that a match across their border is told as two.

Null and empty texts have no words and are never hit. Null items have no windows; a null
item_id is written as an empty string. Repeated documents are judged one by one; repeated items
count once per item_id. An empty benchmark hits nothing, an empty table gives no rows. Other
columns, whatever their names, come through decontaminated() unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import LOWER, aside, back, buffer_of, configure, pieces, redotted, span_hashes, undotted, word_spans, written

WINDOW = 10
#: Bytes of a block's arrays, and how many of them a byte of text makes (measured: 21).
OBJECT_BYTES, OBJECT_SHARE = 64 << 20, 24
BLOCK_BYTES = OBJECT_BYTES // OBJECT_SHARE
SHARD_BYTES = 2 << 20
_SLOTS = 1 << 20

ADDED = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>, matches array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"


class Benchmark:
    """Windows of one block of items (name, text, number of its first word), numbered words and what a search needs."""

    def __init__(self, items: list[tuple[str, str, int]], window: int) -> None:
        self.window = window
        self.names = sorted({name for name, _, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        skipped = np.array([skip for _, _, skip in items], np.int64)
        data, offsets = buffer_of(pa.array([text for _, text, _ in items], pa.string()))
        self.data = LOWER[data]
        self.starts, self.ends = word_spans(self.data, offsets)
        row = np.searchsorted(offsets, self.starts, "right") - 1
        self.vocabulary, ids = np.unique(span_hashes(self.data, self.starts, self.ends), return_inverse=True)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        first = np.searchsorted(row, np.arange(len(items)))
        count = np.bincount(row, minlength=len(items))
        at, length, item = [], [], []
        for k, (f, c) in enumerate(zip(first.tolist(), count.tolist())):
            n = max(1, c - window + 1) if c else 0
            at.append(np.arange(f, f + n))
            length.append(np.full(n, min(c, window)))
            item.append(np.full(n, number[items[k][0]]))
        at, length, item = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, length, item))
        padded = np.zeros(len(ids) + window, np.int64)
        padded[: len(ids)] = ids + 1
        table = padded[at[:, None] + np.arange(window)]
        table[np.arange(window) >= length[:, None]] = 0
        # Equal windows are searched once: `owner` lists all places of window k at owner_at[k]:owner_at[k + 1].
        self.table, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        order = np.argsort(which.reshape(-1), kind="stable")
        self.owner_item, self.owner_word = item[order], (at - first[row[at]] + skipped[row[at]] if len(at) else at)[order]
        self.owner_at = np.searchsorted(which.reshape(-1)[order], np.arange(len(self.table) + 1))
        self.length = (self.table > 0).sum(axis=1)
        self.place = at[order][self.owner_at[:-1]] if len(at) else at

    @cached_property
    def openers(self) -> tuple[np.ndarray, np.ndarray]:
        """(a bit table of hashed opening pairs, opening words of one-word windows)."""
        held = np.zeros(_SLOTS, bool)
        held[_pair_slot(self.table[:, 0], self.table[:, 1] if self.window > 1 else 0)] = True
        single = np.zeros(len(self.vocabulary) + 1, bool)
        single[self.table[self.length == 1, 0]] = True
        return held, single

    @cached_property
    def bounds(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        top = np.where(np.arange(self.window) < self.length[:, None], self.table, (1 << self.bits) - 1)
        return packed(self.table, self.bits), packed(top, self.bits)


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & (_SLOTS - 1)


def packed(table: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of numbers as few unsigned keys, most significant first, in the same order."""
    per, keys = 64 // bits, []
    for lo in range(0, table.shape[1], per):
        key = np.zeros(len(table), np.uint64)
        for j in range(lo, min(lo + per, table.shape[1])):
            key = (key << np.uint64(bits)) | table[:, j].astype(np.uint64)
        keys.append(key)
    return keys


def _search(keys: list[np.ndarray], wanted: list[np.ndarray], past: bool) -> np.ndarray:
    """Where each wanted row goes in sorted rows: before equal ones, or past them."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for key, want in zip(keys, wanted):
            here = key[mid]
            less |= same & (here < want)
            same &= here == want
        go = open_ & (less | same if past else less)
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def hits(bench: Benchmark, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, window) of every occurrence of a window in a shard. data: lower-cased bytes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(starts) or not len(bench.table):
        return none
    hashed = span_hashes(data, starts, ends)
    at = np.searchsorted(bench.vocabulary, hashed)
    at[at == len(bench.vocabulary)] = 0
    # Words numbered from 1 as in the benchmark, 0 for others; a 0 stands after each document's last word.
    ids = np.zeros(len(starts) + n_rows + bench.window, np.int64)
    ids[np.arange(len(starts)) + row] = np.where(bench.vocabulary[at] == hashed, at + 1, 0)
    held, single = bench.openers
    suffixes = np.flatnonzero((ids[:-1] > 0) & (held[_pair_slot(ids[:-1], ids[1:])] | single[ids[:-1]]))
    suffixes = suffixes[suffixes < len(starts) + n_rows]
    if not len(suffixes):
        return none
    keys = packed(ids[suffixes[:, None] + np.arange(bench.window)], bench.bits)
    order = np.lexsort(keys[::-1])
    array, keys = suffixes[order], [k[order] for k in keys]
    low, high = bench.bounds
    lo, hi = _search(keys, low, past=False), _search(keys, high, past=True)
    found = np.flatnonzero(hi > lo)
    n = (hi - lo)[found]
    window = np.repeat(found, n)
    place = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[found], n)]
    word = np.searchsorted(np.arange(len(starts)) + row, place)
    # Exact: the words themselves.
    good = np.ones(len(word), bool)
    for j in range(bench.window):
        live = np.flatnonzero(good & (bench.length[window] > j))
        d, b = word[live] + j, bench.place[window[live]] + j
        same = (ends[d] - starts[d]) == (bench.ends[b] - bench.starts[b])
        good[live[~same]] = False
        live, d, b = live[same], d[same], b[same]
        size, k = (ends[d] - starts[d]), 0
        while len(live):
            more = size > k
            live, d, b, size = live[more], d[more], b[more], size[more]
            bad = data[starts[d] + k] != bench.data[bench.starts[b] + k]
            good[live[bad]] = False
            live, d, b, size, k = live[~bad], d[~bad], b[~bad], size[~bad], k + 1
    return word[good], window[good]


def longest(bench: Benchmark, word: np.ndarray, window: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Occurrences chained into longest verbatim matches: rows (document row, item, first word in the shard, first word in the item, words)."""
    n = bench.owner_at[window + 1] - bench.owner_at[window]
    own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bench.owner_at[window], n)
    p, size = np.repeat(word, n), np.repeat(bench.length[window], n)
    item, q = bench.owner_item[own], bench.owner_word[own]
    order = np.lexsort((p, p - q, item, row[p]))
    p, q, item, size = p[order], q[order], item[order], size[order]
    doc = row[p]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((p - q)[1:] != (p - q)[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(p)) - 1 if len(p) else first
    return np.column_stack([doc[first], item[first], p[first], q[first], p[last] - p[first] + size[last]])


def _scan(bench: Benchmark, column: pa.Array) -> tuple[list, ...]:
    """n_words, spans, items and matches of each text."""
    whole, offsets = buffer_of(column)
    n_words, spans, items, matches = [], [], [], []
    for lo, hi in pieces(offsets, SHARD_BYTES):
        at = offsets[lo : hi + 1] - offsets[lo]
        data = LOWER[whole[offsets[lo] : offsets[hi]]]
        starts, ends = word_spans(data, at)
        row = np.searchsorted(at, starts, "right") - 1
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        word, window = hits(bench, data, starts, ends, row, hi - lo)
        chains = longest(bench, word, window, row)
        cut = np.searchsorted(chains[:, 0], np.arange(hi - lo + 1))
        n_words += np.diff(first).tolist()
        for k in range(hi - lo):
            mine = [(bench.names[i], p - int(first[k]), q, n) for _, i, p, q, n in chains[cut[k] : cut[k + 1]].tolist()]
            spans.append(merged([(p, p + n) for _, p, _, n in mine]))
            items.append(sorted({i for i, *_ in mine}))
            matches.append([{"item_id": i, "doc_word": p, "item_word": q, "n_words": n} for i, p, q, n in mine])
    return n_words, [[{"start": a, "stop": b} for a, b in x] for x in spans], items, matches


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as few spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def parts_of(text: str, limit: int, window: int) -> Iterator[tuple[str, int]]:
    """A text in parts of about limit bytes that overlap by window - 1 words, each with the number of its first word."""
    if len(text) <= limit:
        yield text, 0
        return
    data = text.encode()
    starts, ends = word_spans(LOWER[np.frombuffer(data, np.uint8)], np.array([0, len(data)]))
    lo = 0
    while lo < len(starts):
        # At least a word more than the overlap, or the next part would begin where this one does.
        hi = max(lo + window, int(np.searchsorted(ends, starts[lo] + limit, "right")))
        yield data[starts[lo] : ends[min(hi, len(starts)) - 1]].decode(), lo
        if hi >= len(starts):
            return
        lo = hi - window + 1


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[list[tuple[str, str, int]]]:
    """The items in blocks of about limit bytes of text, one block at a time on the driver."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        for part, skip in parts_of(r.text, limit, window):
            n = len(part.encode())
            if held and size + n > limit:
                yield held
                held, size = [], 0
            held.append((r.name, part, skip))
            size += n
    if held:
        yield held


NAMES = ("n_words", "spans", "items", "matches")


_SPANS, _ITEMS, _MATCHES = "array<struct<start:long,stop:long>>", "array<string>", "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"
_KINDS = [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))]


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (hit words, half-open), items (ids whose windows occur, sorted as strings) and matches (longest verbatim matches and where they are). Columns that docs has under these names are replaced."""
    docs, dotted = undotted(docs)
    spark = docs.sparkSession
    configure(spark)
    rest = [c for c in docs.columns if c not in NAMES]
    kept = docs.select(*rest)
    todo = blocks(benchmark, block_bytes, window)
    first, second = next(todo, []), next(todo, None)
    if second is not None:
        return redotted(_joined(kept, rest, _block_hits(docs, chain([first, second], todo), window)), dotted)
    shared = spark.sparkContext.broadcast(Benchmark(first, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, *more = _scan(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n_words, pa.int64()), *map(pa.array, more, _KINDS)], [*rest, *NAMES])

    return redotted(kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(ADDED).fields])), dotted)


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def _block_hits(docs: DataFrame, todo: Iterator[list[tuple[str, str, int]]], window: int) -> DataFrame:
    """What each block finds, one row per text (by its digest) that it hits: no text is written, and texts without a hit leave nothing."""
    spark, parts = docs.sparkSession, []
    bodies = docs.select(_digest().alias("digest"), F.col("text").cast("string").alias("text"))
    for items in todo:
        shared = spark.sparkContext.broadcast(Benchmark(items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, *more = _scan(shared.value, batch.column("text"))
                hit = pa.array([bool(x) for x in more[1]], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("digest"), *map(pa.array, more, _KINDS)], ["digest", *NAMES[1:]]).filter(hit)

        hits = bodies.mapInArrow(run, f"digest string, spans {_SPANS}, items {_ITEMS}, matches {_MATCHES}")
        parts.append(written(hits.dropDuplicates(["digest"]), "hits"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def _joined(kept: DataFrame, rest: list[str], hits: DataFrame) -> DataFrame:
    """Rows with the finds of all blocks, joined once by the digests of texts (a text that many rows have is split by adaptive execution, unless the finds are few enough to be sent to all)."""
    lists = lambda c: F.flatten(F.collect_list(c)).alias(f"__{c}")
    whole = hits.groupBy(F.col("digest").alias("__digest")).agg(lists("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("__matches"))
    rows = kept.withColumn("__d", _digest()).join(whole, F.col("__d") == F.col("__digest"), "left").select(*rest, "__spans", "__items", "__matches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            starts, _ = word_spans(LOWER[data], offsets)
            n_words = np.diff(np.searchsorted(starts, offsets))
            spans, items, matches = (batch.column(c).to_pylist() for c in ("__spans", "__items", "__matches"))
            spans = [[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in x or []])] for x in spans]
            more = [spans, [x or [] for x in items], [x or [] for x in matches]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n_words, pa.int64()), *map(pa.array, more, _KINDS)], [*rest, *NAMES])

    return rows.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(ADDED).fields]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those in which any benchmark window occurs."""
    kept = found(aside(docs, NAMES), benchmark, window).where(F.size("items") == 0)
    return back(kept, docs.columns, NAMES)
