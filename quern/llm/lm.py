"""Language-model scores by logistic context mixing.

A text is the stream of its lower-cased words with a space between and a line end after the
last. Bytes are coded bit by bit along Huffman trees of the training bytes, one for each of
the most frequent pairs of bytes before (few bits a byte, so little to mix). For every bit
several predictors, each a table of bit counts addressed by a hash of its context (the last two,
four and six bytes, the word so far, that and the word before) and the tree node, give a
probability; their logits are added with weights. A gate (how often the contexts of six bytes and
of the word were met, and whether a word begins) chooses the weights in use, which move after each
byte by the gradient of its coding cost. The mixed probability is refined by an adaptive map: of
the place in the word and the mixed logit, interpolated between two of its points, which move too.
The mean of mixed and refined probability codes the bit.

Weights and map start from values learned beforehand on all training documents: one half of them,
told by hash, fills tables of full size, with which the whole other half is coded. Documents to
code are dealt to groups by hash; a group is coded in blocks, one after another, each from what the
stretches of the block before ended with on average, and the ends of all groups are averaged by
their bytes. A text is coded in stretches of STRETCH bytes, each from those values on (contexts
reach over their borders), so a score is a function of the text alone and long texts are coded side
by side with short ones.

Counts of all predictors are gathered over all training documents, by halves: every task counts the bytes it
meets by context, deals each different one's count to the bits on its way and sends those as sorted
addresses; they are summed by chunks in levels of FAN_IN and at last by chunk alone.
Tables grow with the corpus: a slot for every BYTES_EACH training bytes, LEAST_SLOTS at least. The
finished tables (two bytes a slot and predictor) are broadcast as compressed chunks. A worker holds them
whole up to HELD_SLOTS; beyond that each chunk is a broadcast of its own and a worker holds one at a time: contexts
depend on the text alone, so what the tables say of all bits of LOOKED_BYTES is looked up chunk by chunk before they are coded.

The base score needs every token's exact training count: groups of documents send their
distinct tokens with counts to buckets by hash, buckets add up and answer in the same order.
Tokens are told by 64-bit hashes.

Null texts count as empty: one end token. A null id counts as an empty text in the split,
so those rows are trained on if crc32 of nothing says so. Without training documents all
counts are zero and every bit has even odds. Repeated rows are counted as often as they stand and
scored alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import buffer_of, configure, forget, pieces, release_memory, span_hashes, texts, written

FOLDS, HELD = 7, 2
#: Training bytes that a slot of each table is made for, and the smallest table.
BYTES_EACH, LEAST_SLOTS = 64, 1 << 18
ORDERS = ("two", "four", "six", "word", "words")
CHUNKS = 64
FAN_IN = 64
#: Tables of more slots (168 MB together) are not held whole by a worker: it looks up all bits of LOOKED_BYTES of text at once, one chunk after another.
HELD_SLOTS, LOOKED_BYTES = 1 << 24, 2 << 20
#: Counts that are turned into logits at once.
LOGIT_COUNTS = 1 << 17
#: Slots that lie together (a cache line): those of one context, which its tree nodes are dealt to.
LINE = 32
#: Small pieces keep what is worked on in a core's cache.
COUNT_BYTES = 1 << 15
#: Bytes that are counted at once.
MET_BYTES = 1 << 19
CONTEXT_BYTES = 1 << 15
#: Bytes that are coded side by side, and how many of one text after another.
SCORE_BYTES = 2 << 20
STRETCH = 2048
#: Bytes whose bits are looked up at once: as many as a core's cache holds with all that is known of them.
WINDOW_BYTES = 1 << 15
TOKEN_BYTES = 1 << 19
GROUP_BYTES = 8 << 20
#: How far a unit of gradient moves a weight, and an error a point of the map.
RATE, MAP_RATE = 0.02, 0.02
#: Logits are kept as 14-bit integers above two bits that say how often the slot was met (0, 1-2, 3-15, more).
LOGIT_SCALE, LARGEST_LOGIT = 800.0, 10.0
#: Whether a word begins, times how often the contexts of six bytes and of the word were met.
GATES = 32
#: The predictors whose counts the gate looks at, and what each of its four steps adds.
GATED = {2: 4, 3: 1}
#: Places in a word times points of the map, over mixed logits from -MAP_LIMIT to MAP_LIMIT.
PLACES, POINTS, MAP_LIMIT = 8, 24, 8.0
#: Weights and map are learned by blocks of FIT_BYTES, or smaller ones where a group has fewer than FIT_BLOCKS of them.
FIT_BYTES, FIT_BLOCKS = 1 << 20, 4
#: Values learned are summed as whole numbers, so that no order of groups matters.
FIT_SCALE = 1 << 20
#: Of models that are fitted on some streams at hand: rounds, and slots of their tables.
FIT_ROUNDS, FIT_SLOTS = 3, 1 << 20
#: Pairs of bytes with a code of their own, the most frequent ones.
PAIRS = 1024
#: Weights of a row, a power of two so that the row is one item.
_ROW = 8
_ROW_TYPE = np.dtype(f"V{4 * _ROW}")
_ONE, _LEAST, _MOST = np.float32(1), np.float32(-20), np.float32(20)
_MAP_LEAST, _MAP_MOST, _MAP_STEP = np.float32(-MAP_LIMIT), np.float32(MAP_LIMIT), np.float32((POINTS - 1) / (2 * MAP_LIMIT))
_LAST = np.float32(POINTS - 2)
_PAD = b"\n" * 6
_END = np.uint64(0x2545F4914F6CDD1D)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == HELD


# Tokens and their exact counts.


def stream(body: bytes) -> bytes:
    """The coded form of a text: lower-cased words, a space between, a line end."""
    return b" ".join(body.lower().split()) + b"\n"


def tokens(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts in order, where each text's begin and end). The end token comes last in each text."""
    hashes, ends, at, total = [], [0], 0, 0
    while at < len(bodies):
        upto, size = at, 0
        while upto < len(bodies) and (upto == at or size + len(bodies[upto]) <= TOKEN_BYTES):
            size += len(bodies[upto])
            upto += 1
        data = np.frombuffer(b"".join(bodies[at:upto]), np.uint8)
        stop = np.flatnonzero((data == 0x20) | (data == 0x0A))
        start = np.append(0, stop[:-1] + 1)
        h = span_hashes(data, start, stop)
        # A line end closes a word and is a token itself; in an empty text there is no word before it.
        last = data[stop] == 0x0A
        n = np.where(last, np.where(stop > start, 2, 1), 1)
        out = np.repeat(h, n)
        place = np.cumsum(n)
        out[place[last] - 1] = _END
        hashes.append(out)
        ends += (total + place[last]).tolist()
        total += len(out)
        at = upto
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(ends)


class Group:
    def __init__(self, docs: pa.Table) -> None:
        data, offsets = buffer_of(docs.column("text"))
        body, at = data.tobytes(), offsets.tolist()
        self.held = docs.column("held_out").to_numpy()
        self.offsets, self.bodies = offsets, [stream(body[a:b]) for a, b in zip(at, at[1:])]
        h, self.ends = tokens(self.bodies)
        self.distinct, self.which = np.unique(h, return_inverse=True)
        trained = np.repeat(~self.held, np.diff(self.ends))
        self.counts = np.bincount(self.which[trained], minlength=len(self.distinct))

    def cuts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, where each one's distinct tokens begin)."""
        bucket = ((self.distinct >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        return bucket[first], np.append(first, len(bucket))


_SENT = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("hash", pa.binary()), ("count", pa.binary())])
_ANSWER = pa.schema([("g", pa.int64()), ("b", pa.int64()), ("count", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])


def _send(docs: pa.Table, n: int) -> pa.Table:
    group, g = Group(docs), docs.column("g")[0].as_py()
    bucket, at = group.cuts(n)
    spans = list(zip(at.tolist(), at[1:].tolist()))
    return pa.table([pa.array(bucket), pa.array([g] * len(spans), pa.int64()), pa.array([group.distinct[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([group.counts[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary())], schema=_SENT)


def _add(sent: pa.Table) -> pa.Table:
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in sent.column("hash")]
    counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in sent.column("count")]
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, np.concatenate(counts).astype(np.int64))
    at = np.cumsum([0, *map(len, hashes)])
    found = [total[which[a:b]].tobytes() for a, b in zip(at, at[1:])]
    n = len(found)
    # Bucket totals stand in the first row alone.
    return pa.table([sent.column("g"), sent.column("b"), pa.array(found, pa.binary()), pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()), pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64())], schema=_ANSWER)


# Bits.


@dataclass
class Code:
    """Huffman codes of bytes, one for each of some contexts: the two bytes before, where that pair is frequent, else the one byte before.

    Byte b after bytes x, y has steps at first[k] : first[k] + length[k], k = 256 * which[256 x + y] + b.
    A step is a tree node's number (its higher bits) and the bit that follows (its lowest).
    """

    which: np.ndarray
    first: np.ndarray
    length: np.ndarray
    steps: np.ndarray


def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """(node, bit) on the way to each byte in the Huffman tree of counts + 1."""
    heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        name = 256 + len(children)
        children[name] = a[2], b[2]
        heapq.heappush(heap, (a[0] + b[0], name, name))
    paths: list[list[tuple[int, int]]] = [[]] * 256
    todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if node < 256:
            paths[node] = path
        else:
            todo += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
    return paths


def huffman(ones: np.ndarray, pairs: dict[int, np.ndarray]) -> Code:
    """ones: counts of bytes after each byte (256 x 256); pairs: counts of bytes after some pairs (256 x + y)."""
    which = np.tile(np.arange(256), 256)
    contexts = [ones[y] for y in range(256)]
    for pair, counts in sorted(pairs.items()):
        which[pair] = len(contexts)
        contexts.append(counts)
    paths = [path for counts in contexts for path in _paths(counts)]
    length = np.array([len(x) for x in paths], np.uint8)
    flat = np.array([x for path in paths for x in path], np.int64).reshape(-1, 2)
    # Nodes are numbered as they were joined, the root last: those nearest to it differ in their lowest bits, which choose a slot.
    nodes = flat[:, 0].astype(np.uint32)
    return Code(which.astype(np.int32), np.cumsum(length, dtype=np.int64) - length, length, nodes << np.uint32(1) | flat[:, 1].astype(np.uint32))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _scrambled(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(odd)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def word_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte: its place, and where its word begins."""
    at = np.arange(len(data), dtype=np.int32)
    gap = (data == 0x20) | (data == 0x0A)
    start = np.zeros(len(data), np.int32)
    start[1:][gap[:-1]] = at[1:][gap[:-1]]
    return at, np.maximum.accumulate(start)


def contexts(data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For every byte: a hash of each predictor's context, and how many bytes of its word come before it."""
    past = np.zeros(len(data) + 8, np.uint64)  # at k: bytes k - 8 to k - 1, the last one lowest
    past[8:] = data
    for shift in (1, 2, 4):
        past[shift:] |= past[:-shift] << np.uint64(8 * shift)
    past = past[7:-1]
    at, start = word_starts(data)
    ahead = at - start
    out = [_scrambled(past & _LOW_BYTES[k], odd) for k, odd in ((2, 0xA24BAED4963EE407), (4, 0xC2B2AE3D27D4EB4F), (6, 0x9FB21C651E98DF25))]
    word = (span_hashes(data, start, at) >> np.uint64(32)).astype(np.uint32)
    # At the gap before a word stands the hash of the whole word before it.
    before = word[np.maximum(start - 1, 0)]
    return [*out, word, word * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA6B)], ahead


def joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Streams of some texts in one buffer, each after bytes that reset all contexts: (bytes, places that are coded, their text)."""
    data = np.frombuffer(b"".join(x for b in bodies for x in (_PAD, b)), np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)
    row = np.repeat(np.arange(len(bodies)), size)
    return data, np.arange(len(row)) + (row + 1) * len(_PAD), row


def walked(code: Code, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each byte, by its place in the code, steps of all of them)."""
    n = code.length[key].astype(np.int64)
    upto = np.cumsum(n)
    return n, code.steps.take(np.repeat(code.first[key] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0))


#: A byte met in a context is one number: the context's slot above these bits, the byte's place in the code in them.
PLACE_BITS = 20


def met(bodies: list[bytes], code: Code, slots: int) -> Iterator[tuple[int, np.ndarray]]:
    """(predictor, every byte coded as met in that predictor's context), all of a predictor's at once."""
    # Contexts are worked out by pieces that a core's cache holds.
    slot: list[list[np.ndarray]] = [[] for _ in ORDERS]
    keys = [np.zeros(0, np.uint32)]
    for lo, hi in pieces(np.cumsum([0, *map(len, bodies)]), COUNT_BYTES):
        data, coded, _ = joined(bodies[lo:hi])
        real = np.zeros(len(data), bool)
        real[coded] = True
        last = data.astype(np.int32)
        pair = np.zeros(len(data), np.int32)
        pair[2:] = (last[:-2] << 8) | last[1:-1]
        keys.append(((code.which.take(pair) << 8) | last).astype(np.uint32)[real])
        for k, h in enumerate(contexts(data)[0]):
            slot[k].append((h & np.uint32(slots - 1))[real])
    key = np.concatenate(keys)
    for k, found in enumerate(slot):
        whole = np.concatenate(found or [key]).astype(np.uint64)
        found.clear()
        whole <<= np.uint64(PLACE_BITS)
        whole |= key
        yield k, whole


def bits_met(found: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each byte as met, 2 * slot + bit of every one)."""
    n, step = walked(code, (found & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64))
    slot = np.repeat((found >> np.uint64(PLACE_BITS)).astype(np.uint32), n) ^ (step >> np.uint32(1) & np.uint32(LINE - 1))
    return n, (slot << np.uint32(1)) | (step & np.uint32(1))


def addresses(bodies: list[bytes], code: Code, slots: int) -> Iterator[tuple[int, np.ndarray]]:
    """(predictor, 2 * slot + bit of every bit coded) by pieces of the texts."""
    for k, found in met(bodies, code, slots):
        yield k, bits_met(found, code)[1]


def counted_bits(found: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(addresses of bits in order, their counts) from counts of bytes as met, which are in order."""
    n, at = bits_met(found, code)
    # Bits of a context stay in its line, and lines are in order: only those met are laid out.
    line = (found >> np.uint64(PLACE_BITS)).astype(np.int64) // LINE
    new = np.append(True, line[1:] != line[:-1])[: len(line)]
    spread = np.bincount(np.repeat(2 * LINE * (np.cumsum(new) - 1), n) + (at & np.uint32(2 * LINE - 1)), np.repeat(counts, n))
    place = np.flatnonzero(spread)
    return (2 * LINE * line[new][place // (2 * LINE)] + place % (2 * LINE)).astype(np.uint32), spread[place].astype(np.uint64)


#: A number and how often it was met are one, the number above these bits: so counts are added by sorting. Larger counts stand in several.
TIMES_BITS = 14
_TIMES = np.uint64((1 << TIMES_BITS) - 1)


class Counts:
    """Counts of numbers below 2^50, in order: as large as what was met, not as the table."""

    RAW, LEAST = 1 << 19, 1 << 19
    #: Different numbers after which a task hands over what it has and counts afresh.
    MOST = 3 << 20

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.parts = [np.zeros(0, np.uint64)]
        self.n_raw = 0

    def add(self, found: np.ndarray) -> None:
        self.raw.append(found)
        self.n_raw += len(found)
        if self.n_raw >= self.RAW:
            self._settle()

    @staticmethod
    def _both(numbers: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Numbers in order and their counts as one."""
        numbers, over = numbers << np.uint64(TIMES_BITS), times > _TIMES
        if over.any():
            full = (times - np.uint64(1)) // _TIMES
            return np.append(numbers | (times - full * _TIMES), np.repeat(numbers | _TIMES, full.astype(np.int64)))
        return numbers | times

    def _settle(self) -> None:
        if self.n_raw:
            found = np.concatenate(self.raw).astype(np.uint64, copy=False)
            self.raw, self.n_raw = [], 0
            found.sort()
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            self.parts.append(self._both(found[first], np.diff(np.append(first, len(found))).astype(np.uint64)))
        if sum(map(len, self.parts[1:])) > max(self.LEAST, len(self.parts[0])):
            self._merge()

    def _summed(self) -> tuple[np.ndarray, np.ndarray]:
        found = np.concatenate(self.parts)
        self.parts = []
        found.sort()
        numbers = found >> np.uint64(TIMES_BITS)
        found &= _TIMES
        upto = np.cumsum(found, out=found)
        last = np.flatnonzero(np.append(numbers[1:] != numbers[:-1], True)[: len(numbers)])
        return numbers[last], np.diff(upto[last], prepend=np.uint64(0))

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [self._both(*self._summed())]

    @property
    def full(self) -> bool:
        return len(self.parts[0]) > self.MOST

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers in order, their counts)."""
        self._settle()
        numbers, times = self._summed()
        self.parts = [self._both(numbers, times)]
        return numbers, times


def logits(counts: np.ndarray) -> np.ndarray:
    """Slots as 16-bit integers: the logit of a one (smoothed) and how often the slot was met."""
    none, one = counts[0::2].astype(np.float64), counts[1::2].astype(np.float64)
    met = none + one
    x = np.clip(np.log((one + 0.3) / (none + 0.3)), -LARGEST_LOGIT, LARGEST_LOGIT)
    return (np.rint(x * LOGIT_SCALE).astype(np.int16) << 2) | np.digitize(met, [1, 3, 16]).astype(np.int16)


#: What a slot says that was never met.
EMPTY = logits(np.zeros(2, np.uint64))[0]


@dataclass
class Start:
    """What every stretch starts from: weights of each predictor by gate, and points of the map by place."""

    weights: np.ndarray
    points: np.ndarray

    @classmethod
    def plain(cls) -> Start:
        """Weights all alike, and a map that changes nothing."""
        line = 1 / (1 + np.exp(-np.linspace(-MAP_LIMIT, MAP_LIMIT, POINTS)))
        return cls(np.full((len(ORDERS), GATES), 0.4, np.float32), np.tile(line.astype(np.float32), (PLACES, 1)))


@dataclass
class Model:
    code: Code
    tables: list[np.ndarray]
    start: Start

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        """log10 of the probability of each stream."""
        found = [self.coded(bodies[lo:hi], told)[0] for lo, hi, told in self.lots(bodies, SCORE_BYTES)]
        return -np.concatenate([np.zeros(0), *found]) * np.log10(2)

    def lots(self, bodies: list[bytes], limit: int) -> Iterator[tuple[int, int, list[np.ndarray] | None]]:
        """Ranges of streams to code at once, and what is known of their bits beforehand."""
        for lo, hi in pieces(np.cumsum([0, *map(len, bodies)]), limit):
            yield lo, hi, None

    def coded(self, bodies: list[bytes], said: list[np.ndarray] | None = None) -> tuple[np.ndarray, Start]:
        """(bits that each stream costs, the mean of what the stretches end with). said: what each table says of all bits, where that has been looked up."""
        data = np.frombuffer(b"".join(x for b in bodies for x in (_PAD, b)), np.uint8)
        size = np.array([len(b) for b in bodies], np.int64)
        first = np.cumsum(size + len(_PAD)) - size
        K, mask = len(ORDERS), np.uint32(len(self.tables[0]) - 1 if said is None else 0)
        # What is known of a byte lies together: its contexts' slots, its place in the code, how many bytes of its word come before it,
        # and where its bits begin among those that were looked up.
        known = np.empty((len(data), _ROW), np.uint32)
        upto = np.append(0, first + size)
        for lo, hi in pieces(upto, CONTEXT_BYTES):
            part, own = data[upto[lo] : upto[hi]], known[upto[lo] : upto[hi]]
            if said is None:
                hashed, ahead = contexts(part)
                for k, h in enumerate(hashed):
                    np.bitwise_and(h, mask, out=own[:, k])
            else:
                ahead = np.subtract(*word_starts(part))
            last = part.astype(np.int32)
            pair = np.zeros(len(part), np.int32)
            pair[2:] = (last[:-2] << 8) | last[1:-1]
            own[:, K] = (self.code.which.take(pair) << 8) | last
            own[:, K + 1] = ahead
        if said is not None:
            known[:, K + 2] = 0
            real = np.arange(size.sum()) + np.repeat(np.arange(1, len(size) + 1) * len(_PAD), size)
            n = self.code.length.take(known[real, K]).astype(np.uint32)
            known[real, K + 2] = np.cumsum(n, dtype=np.uint32) - n
        known = known.view(_ROW_TYPE).reshape(-1)
        # Stretches, the longest first: those with another byte to come are the first ones at every step.
        n = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(bodies)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(size[doc] - nth * STRETCH, STRETCH)
        rank = np.argsort(-length, kind="stable")
        begin, length, doc = (first[doc] + nth * STRETCH)[rank], length[rank], doc[rank]
        lanes = len(begin)
        # Weights of one stretch and gate lie together, as the logits are kept: times LOGIT_SCALE. A row of them is read and written as one item.
        weights = np.zeros((lanes * GATES, _ROW), np.float32)
        weights.reshape(lanes, GATES, _ROW)[:, :, :K] = self.start.weights.T / np.float32(LOGIT_SCALE)
        rows = weights.view(_ROW_TYPE).reshape(-1)
        rate = np.float32(RATE / LOGIT_SCALE**2)
        # Made here: numpy adds at places some fifteen times slower to an array whose type has come out of a pickle.
        points = np.empty((lanes, PLACES * POINTS), np.float32)
        points[:] = self.start.points.reshape(-1)
        points = points.reshape(-1)
        cost = np.zeros(lanes)
        live = np.searchsorted(-length, -np.arange(1, (length[0] if lanes else 0) + 1), "right")
        # Tables don't move, so what they say of all bits of some steps is looked up at once, in the order of the steps;
        # weights and map alone go byte by byte.
        done = 0
        while done < len(live):
            m = live[done : done + max(1, WINDOW_BYTES // int(live[done]))]
            opens = np.cumsum(m) - m
            step = np.repeat(np.arange(len(m)), m)
            lane = np.arange(len(step)) - opens.take(step)
            about = known.take(begin.take(lane) + (step + done)).view(np.uint32).reshape(-1, _ROW)
            done += len(m)
            bits = self.code.length.take(about[:, K]).astype(np.int64)
            # Bytes of a step with more bits come first, and of their bits all first ones, then all second ones:
            # those of any place are then the bits of the first bytes, each of another stretch.
            deep = int(bits.max())
            held = np.bincount(step * deep + bits - 1, minlength=len(m) * deep).reshape(-1, deep)[:, ::-1].cumsum(axis=1)[:, ::-1]
            order = step * deep + (deep - bits)
            order = np.argsort(order.astype(np.uint16) if len(m) * deep < 1 << 16 else order, kind="stable")
            lane, about = lane.take(order), np.ascontiguousarray(about.view(_ROW_TYPE).reshape(-1).take(order).view(np.uint32).reshape(-1, _ROW)[:, : K + 2 + (said is not None)].T)
            runs = held.ravel()
            starts = np.cumsum(runs) - runs
            n_bits = int(starts[-1] + runs[-1])
            own = np.repeat(np.repeat(opens, deep) - starts, runs)  # of each bit: its byte
            own += np.arange(n_bits)
            nth = np.repeat(np.tile(np.arange(deep), len(m)), runs)
            way = self.code.first.take(about[K]).take(own, mode="clip")
            way += nth
            way = self.code.steps.take(way)
            bit = (way & np.uint32(1)).astype(np.float32)
            node = (way >> np.uint32(1) & np.uint32(LINE - 1)).astype(np.int64)
            heads = starts[::deep].take(step) + np.arange(len(step)) - opens.take(step)
            x, place = np.zeros((n_bits, _ROW), np.int16), about[K + 1].astype(np.int64)
            gate = lane * GATES + (place == 0) * 16
            if said is not None:
                nth += about[K + 2].astype(np.int64).take(own, mode="clip")
            for k in range(K):
                if said is None:
                    slot = about[k].astype(np.int64).take(own, mode="clip")
                    slot ^= node
                    raw = self.tables[k].take(slot, mode="clip")
                else:
                    raw = said[k].take(nth, mode="clip")
                if k in GATED:
                    gate += (raw.take(heads) & 3) * GATED[k]
                x[:, k] = raw
            x >>= 2
            x = x.astype(np.float32)
            spots = (lane * (PLACES * POINTS) + np.minimum(place, PLACES - 1) * POINTS).take(own, mode="clip")
            told = np.empty(n_bits, np.float32)
            lo = 0
            for a, n, counts in zip(opens.tolist(), m.tolist(), held.tolist()):
                counts = [c for c in counts if c]
                hi = lo + sum(counts)
                y, z, g = x[lo:hi], bit[lo:hi], gate[a : a + n]
                used = rows.take(g, mode="clip").view(np.float32).reshape(n, _ROW)
                mixed = np.concatenate([used[:c] for c in counts])
                mixed *= y
                # Column by column: a product with ones would add in an order that depends on the row's place.
                parts, mixed = mixed, mixed[:, 0] + mixed[:, 1]
                for k in range(2, K):
                    mixed += parts[:, k]
                odds = np.minimum(np.maximum(mixed, _LEAST), _MOST)
                np.negative(odds, out=odds)
                np.exp(odds, out=odds)
                odds += _ONE
                np.divide(_ONE, odds, out=odds)
                spot = np.minimum(np.maximum(mixed, _MAP_LEAST), _MAP_MOST)
                spot += _MAP_MOST
                spot *= _MAP_STEP
                whole = np.minimum(np.floor(spot), _LAST)
                spot -= whole
                low = whole.astype(np.int64)
                low += spots[lo:hi]
                high = low + 1
                left, right = points.take(low, mode="clip"), points.take(high, mode="clip")
                found = right - left
                found *= spot
                found += left
                np.add(found, odds, out=told[lo:hi])
                np.subtract(z, odds, out=odds)
                odds *= rate
                y *= odds.repeat(_ROW).reshape(-1, _ROW)
                upto = 0
                for c in counts:
                    used[:c] += y[upto : upto + c]
                    upto += c
                rows[g] = used.view(_ROW_TYPE).reshape(-1)
                spot *= np.float32(MAP_RATE)
                np.subtract(z, right, out=right)
                right *= spot
                np.subtract(np.float32(MAP_RATE), spot, out=spot)
                np.subtract(z, left, out=left)
                left *= spot
                np.add.at(points, low, left)
                np.add.at(points, high, right)
                lo = hi
            told *= np.float32(0.5)
            told += bit
            told -= _ONE
            np.abs(told, out=told)
            cost -= np.bincount(lane, np.bincount(own, np.log(told, out=told), len(lane)), lanes)
        cost /= np.log(2)
        weights = weights.reshape(lanes, GATES, _ROW)[:, :, :K].transpose(2, 0, 1) * np.float32(LOGIT_SCALE)
        out = np.bincount(doc, cost, len(bodies))
        # Long stretches have learned more.
        share = (length / max(1, length.sum())).astype(np.float32)
        ended = Start(np.einsum("klg,l->kg", weights, share), np.clip(np.einsum("lx,l->x", points.reshape(lanes, -1), share), 1e-4, 1 - 1e-4).reshape(PLACES, POINTS)) if lanes else self.start
        return out, ended


@dataclass
class Dealt(Model):
    """A model whose tables are in memory one chunk at a time, so that they can grow with the corpus: what they say of all bits of
    some streams is looked up before these are coded. chunks: compressed ones by number, empty ones left out; tables is empty."""

    slots: int
    chunks: dict[int, Broadcast]

    def lots(self, bodies: list[bytes], limit: int) -> Iterator[tuple[int, int, list[np.ndarray] | None]]:
        waiting: list[tuple[int, int]] = []
        offsets = np.cumsum([0, *map(len, bodies)])

        def given() -> Iterator[tuple[int, int, list[np.ndarray]]]:
            if waiting:
                begin = waiting[0][0]
                told, at = self.looked_up(bodies[begin : waiting[-1][1]])
                for lo, hi in waiting:
                    yield lo, hi, [x[at[lo - begin] : at[hi - begin]] for x in told]

        for lo, hi in pieces(offsets, limit):
            if waiting and offsets[hi] - offsets[waiting[0][0]] > LOOKED_BYTES:
                yield from given()
                waiting = []
            waiting.append((lo, hi))
        yield from given()

    def looked_up(self, bodies: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """(what each table says of all bits of the streams in order, where each stream's bits begin and end)."""
        told, size = [], self.slots // CHUNKS
        offsets = np.cumsum([0, *map(len, bodies)])
        bits = np.zeros(1, np.int64)
        for k, found in met(bodies, self.code, self.slots):
            if not k:
                bits = np.append(0, np.cumsum(self.code.length.take((found & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)), dtype=np.int64))
            said = np.full(bits[-1], EMPTY, np.int16)
            chunk = (found >> np.uint64(PLACE_BITS + size.bit_length() - 1)).astype(np.uint8)
            order, upto = np.argsort(chunk, kind="stable").astype(np.uint32), np.append(0, np.cumsum(np.bincount(chunk, minlength=CHUNKS)))
            for c, (a, b) in enumerate(zip(upto.tolist(), upto[1:].tolist())):
                if a == b or k * CHUNKS + c not in self.chunks:
                    continue
                table = np.frombuffer(zstandard.decompress(opened(self.chunks[k * CHUNKS + c])), np.int16)
                for lo in range(a, b, CONTEXT_BYTES):
                    own = order[lo : min(lo + CONTEXT_BYTES, b)]
                    n, at = bits_met(found.take(own), self.code)
                    place = np.repeat(bits.take(own) - (np.cumsum(n) - n), n) + np.arange(len(at))
                    said[place] = table.take((at >> np.uint32(1)) & np.uint32(size - 1))
            told.append(said)
        return told, bits[offsets]


def opened(shared: Broadcast) -> bytes:
    """What was broadcast, read from its file anew each time: nothing of it stays in memory."""
    found = shared.value
    if shared._path is not None:
        vars(shared).pop("_value", None)
    return found


def halved() -> Column:
    """Whether a training document is one of those that weights and map are learned on; the others fill the tables for it."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(2)) == 1


def learned(model: Model, bodies: list[bytes]) -> Start:
    """Weights and map after some streams, block by block; model.start moves with them."""
    for lo, hi, told in model.lots(bodies, min(FIT_BYTES, -(-sum(map(len, bodies)) // FIT_BLOCKS))):
        model.start = model.coded(bodies[lo:hi], told)[1]
    return model.start


def fitted(code: Code, bodies: list[bytes]) -> Start:
    """Weights and map learned on some streams: every other one is counted, the rest is coded with those counts."""
    counts = [np.zeros(2 * FIT_SLOTS, np.uint32) for _ in ORDERS]
    for k, at in addresses(bodies[::2], code, FIT_SLOTS):
        np.add.at(counts[k], at.astype(np.int64), np.uint32(1))
    model = Model(code, [logits(c) for c in counts], Start.plain())
    if len(bodies) > 1:
        for _ in range(FIT_ROUNDS):
            model.start = model.coded(bodies[1::2])[1]
    return model.start


@dataclass
class Trained:
    """A model as compressed chunks of its tables, most of whose slots are empty. Those of large tables are broadcast one by one, and the driver holds none of them."""

    code: Code
    start: Start
    slots: int
    chunks: dict[int, bytes | Broadcast]

    @cached_property
    def model(self) -> Model:
        """With whole tables, however large."""
        size = self.slots // CHUNKS
        tables = [np.full(self.slots, EMPTY, np.int16) for _ in ORDERS]
        for chunk, body in self.chunks.items():
            order, k = divmod(chunk, CHUNKS)
            tables[order][k * size : (k + 1) * size] = np.frombuffer(zstandard.decompress(body if isinstance(body, bytes) else opened(body)), np.int16)
        return Model(self.code, tables, self.start)

    def shared(self, spark: SparkSession) -> Shared:
        dealt = self.slots > HELD_SLOTS
        return Shared(spark.sparkContext.broadcast(replace(self, chunks={}) if dealt else self), self.chunks if dealt else {}, dealt)


@dataclass
class Shared:
    """A trained model as tasks get it. Broadcasts reach a task only if its function holds them itself."""

    trained: Broadcast
    chunks: dict[int, Broadcast]
    dealt: bool

    @property
    def model(self) -> Model:
        own = self.trained.value
        return Dealt(own.code, [], own.start, own.slots, self.chunks) if self.dealt else own.model

    def destroy(self) -> None:
        for x in (self.trained, *self.chunks.values()):
            x.destroy()


def _pack_counts(order: int, at: np.ndarray, counts: np.ndarray, length: int, salt: int) -> list[tuple]:
    """Rows of the chunks of a table of that length in which anything was counted."""
    out, size = [], length // CHUNKS
    cuts = np.searchsorted(at, np.arange(CHUNKS + 1, dtype=np.int64) * size)
    for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if a < b:
            own = at[a:b] - np.uint32(k * size)
            out.append((order * CHUNKS + k, salt, _body(own, counts[a:b])))
    return out


def _body(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Addresses in order, as distances, and their counts; all lowest bytes come first, then all next ones, as far as any is not zero."""
    planes = []
    for x in (np.diff(at, prepend=np.uint32(0)), counts):
        n = -(-int(x.max()).bit_length() // 8) if len(x) else 0
        planes.append([(x >> x.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(n)])
    return bytes(map(len, planes)) + zstandard.compress(b"".join(planes[0] + planes[1]), 1)


def _unpack(blob: bytes, table: np.ndarray) -> None:
    near, many = blob[:2]
    if not many:
        return
    raw = np.frombuffer(zstandard.decompress(blob[2:]), np.uint8).reshape(near + many, -1)
    at, counts = np.zeros(raw.shape[1], np.uint32), np.zeros(raw.shape[1], np.uint64)
    for k in range(near):
        at |= raw[k].astype(np.uint32) << np.uint32(8 * k)
    for k in range(many):
        counts |= raw[near + k].astype(np.uint64) << np.uint64(8 * k)
    table[np.cumsum(at)] += counts


_PACKED = pa.schema([("chunk", pa.int64()), ("salt", pa.int64()), ("body", pa.binary())])


def _packed(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _PACKED)], schema=_PACKED)


def _sum_chunk(parts: pa.Table, slots: int) -> pa.Table:
    table = np.zeros(2 * slots // CHUNKS, np.uint64)
    for x in parts.column("body"):
        _unpack(x.as_py(), table)
    at = np.flatnonzero(table).astype(np.uint32)
    return _packed([(parts.column("chunk")[0].as_py(), parts.column("salt")[0].as_py() // FAN_IN, _body(at, table[at]))])


def _streams(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    data, offsets = buffer_of(batch.column("text"))
    body, at = data.tobytes(), offsets.tolist()
    return [stream(body[a:b]) for a, b in zip(at, at[1:])], offsets


def slots_for(n_bytes: int) -> int:
    """Slots of a table for that many training bytes."""
    found = max(LEAST_SLOTS, 1 << max(0, n_bytes // BYTES_EACH - 1).bit_length())
    if found > 1 << 30:
        raise ValueError("more slots than 32-bit addresses can tell apart")
    return found


def _sample(docs: DataFrame, n_bytes: int, fit_bytes: int = FIT_BYTES) -> list[bytes]:
    """For looks at a corpus, no model learns from it. Streams of some training documents, chosen by hash, fit_bytes in all at most: the last is cut where it would go over. Where the draw meets none, the document that it would have met next; without documents nothing."""
    share = max(1, n_bytes // fit_bytes)
    draw = F.xxhash64("doc_id", "text", F.lit("fit"))
    out, held = [], 0
    for rows in (docs.where(F.pmod(draw, F.lit(share)) == 0).orderBy(draw, "text"), docs.orderBy(draw, "text").limit(1)):
        for r in rows.select("text").toLocalIterator():
            body = stream((r.text or "").encode())[: fit_bytes - held]
            held += len(body)
            out.append(body)
            if held >= fit_bytes:
                break
        if out:
            break
    return out


def _fit(docs: DataFrame, n_bytes: int, group_bytes: int, trained: Trained) -> Start:
    """Weights and map learned by coding all rows of docs with those tables."""
    spark = docs.sparkSession
    shared = trained.shared(spark)
    n = int(n_bytes // group_bytes) + 1

    def learn(rows: pa.Table) -> pa.Table:
        model = shared.model
        # The rows of a group arrive in any order; by hash, long and short texts are mixed.
        bodies = sorted((x for batch in rows.to_batches() for x in _streams(batch)[0]), key=lambda x: (zlib.crc32(x), x))
        start = learned(replace(model, start=Start.plain()), bodies)
        size = sum(map(len, bodies))
        found = np.concatenate([start.weights.reshape(-1), start.points.reshape(-1)]).astype(np.float64)
        release_memory()
        return pa.table({"place": pa.array(np.arange(len(found))), "value": pa.array(np.rint(found * FIT_SCALE).astype(np.int64) * size), "size": pa.array(np.full(len(found), size, np.int64))})

    groups = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).groupBy("g")
    sums = groups.applyInArrow(learn, "place long, value long, size long").groupBy("place").agg(F.sum("value").alias("value"), F.sum("size").alias("size")).orderBy("place").collect()
    shared.destroy()
    if not sums:
        return Start.plain()
    found = (np.array([r.value for r in sums]) / np.array([r.size for r in sums]) / FIT_SCALE).astype(np.float32)
    cut = len(ORDERS) * GATES
    return Start(found[:cut].reshape(len(ORDERS), GATES), found[cut:].reshape(PLACES, POINTS))


#: Every table made while training is read once, so its shuffle files can go when it is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def train(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> Trained:
    """Counts over all rows of docs (columns doc_id, text); weights and map are learned by coding one half of them with the counts of the other."""
    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return _trained(docs.select("doc_id", "text"), group_bytes)
    finally:
        spark.conf.set(CLEANUP, before)


def _trained(docs: DataFrame, group_bytes: int) -> Trained:
    spark = docs.sparkSession

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 24, np.uint32)
        for batch in batches:
            bodies, offsets = _streams(batch)
            for lo, hi in pieces(offsets):
                data, at, _ = joined(bodies[lo:hi])
                np.add.at(n, (data[at - 2].astype(np.int64) << 16) | (data[at - 1].astype(np.int64) << 8) | data[at], np.uint32(1))
        for key in np.array_split(np.flatnonzero(n), 64):
            yield pa.RecordBatch.from_arrays([pa.array(key >> 8), pa.array(key & 255), pa.array(n[key].astype(np.int64))], ["pair", "byte", "n"])
        del n
        release_memory()

    triples = written(docs.mapInArrow(histogram, "pair long, byte long, n long").groupBy("pair", "byte").agg(F.sum("n").alias("n")), "triples")
    ones = np.zeros((256, 256), np.int64)
    for r in triples.groupBy((F.col("pair") % 256).alias("last"), "byte").agg(F.sum("n").alias("n")).collect():
        ones[r.last, r.byte] = r.n
    n_bytes = int(ones.sum())
    slots = slots_for(n_bytes)
    frequent = triples.groupBy("pair").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "pair").limit(PAIRS)
    pairs: dict[int, np.ndarray] = {}
    for r in triples.join(F.broadcast(frequent), "pair").collect():
        pairs.setdefault(r.pair, np.zeros(256, np.int64))[r.byte] = r.n
    forget(spark, triples)
    code = huffman(ones, pairs)
    docs = docs.withColumn("fit", halved())
    shared = spark.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Numbered by half and predictor.
        counts, salt = [Counts() for _ in range(2 * len(ORDERS))], TaskContext.get().partitionId() // FAN_IN

        def handed(k: int) -> Iterator[pa.RecordBatch]:
            found, n = counts[k].total()
            counts[k] = Counts()
            # A context's bits stay in its line, so runs of chunks can be taken one by one.
            cuts = np.searchsorted(found, np.arange(CHUNKS + 1, dtype=np.uint64) * np.uint64(slots // CHUNKS << PLACE_BITS))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield from _packed(_pack_counts(k, *counted_bits(found[a:b], n[a:b], shared.value), 2 * slots, salt)).to_batches()

        def added(half: int) -> Iterator[pa.RecordBatch]:
            for k, found in met(waiting[half], shared.value, slots):
                k += half * len(ORDERS)
                counts[k].add(found)
                if counts[k].full:
                    yield from handed(k)
            waiting[half], size[half] = [], 0

        # Texts wait until there is enough to sort at once: more of it is alike.
        waiting, size = [[], []], [0, 0]
        for batch in batches:
            for half in (0, 1):
                for body in _streams(batch.filter(pc.equal(batch.column("fit"), bool(half))))[0]:
                    waiting[half].append(body)
                    size[half] += len(body)
                    if size[half] >= MET_BYTES:
                        yield from added(half)
        for half in (0, 1):
            yield from added(half)
            for k in range(half * len(ORDERS), (half + 1) * len(ORDERS)):
                yield from handed(k)
        release_memory()

    ddl = "chunk long, salt long, body binary"
    parts, levels = docs.mapInArrow(count, ddl), -(-docs.rdd.getNumPartitions() // FAN_IN)
    while levels > 1:
        parts = parts.groupBy("chunk", "salt").applyInArrow(lambda t: _sum_chunk(t, slots), ddl)
        levels = -(-levels // FAN_IN)

    def finish(parts: pa.Table) -> pa.Table:
        """However many sums are left of a chunk, they are added here: those of the half that fills tables first (salt 0), then of both (salt 1)."""
        table, rows = np.zeros(2 * slots // CHUNKS, np.uint64), []
        of, bodies = parts.column("chunk").to_numpy(), parts.column("body")
        chunk = int(of[0]) % (len(ORDERS) * CHUNKS)
        for half in (0, 1):
            for at in np.flatnonzero(of // (len(ORDERS) * CHUNKS) == half).tolist():
                _unpack(bodies[at].as_py(), table)
            found = np.concatenate([logits(x) for x in np.array_split(table, -(-len(table) // LOGIT_COUNTS))])
            rows.append((chunk, half, zstandard.compress(found.tobytes(), 1)))
        return _packed(rows)

    done = written(parts.groupBy((F.col("chunk") % (len(ORDERS) * CHUNKS)).alias("both")).applyInArrow(finish, ddl), "tables")
    kept = spark.sparkContext.broadcast if slots > HELD_SLOTS else bytes
    tables = lambda upto: {r.chunk: kept(bytes(r.body)) for r in done.where(F.col("salt") == upto).toLocalIterator()}
    start = _fit(docs.where("fit").select("doc_id", "text"), n_bytes, group_bytes, Trained(code, Start.plain(), slots, tables(0)))
    found = Trained(code, start, slots, tables(1))
    forget(spark, done)
    return found


FOUND = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long"


def scored(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the coded stream) of every document."""
    spark = docs.sparkSession
    configure(spark)
    rows = texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    trained = train(rows.where("not held_out").select("doc_id", "text"), group_bytes).shared(spark)
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(n_bytes // group_bytes) + 1
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))

    # Both passes over the documents share one shuffle of them.
    sent = rows.groupBy("g").applyInArrow(lambda t: _send(t, n), "b long, g long, hash binary, count binary")
    answers = sent.groupBy("b").applyInArrow(_add, "g long, b long, count binary, total long, distinct long")
    sums = answers.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"))
    sums = sums.select(F.struct("total", "distinct").alias("sums")).scalar()

    def score(docs: pa.Table, answer: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in FOUND.split(", ")]
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()])})
        group = Group(docs)
        parts = sorted(zip(answer.column("b").to_pylist(), answer.column("count")), key=lambda x: x[0])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for _, x in parts])[group.which]
        at = group.ends[:-1]
        bodies = group.bodies
        found = trained.model.scores(bodies)
        release_memory()
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(np.diff(group.ends)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)), pa.array(np.add.reduceat(np.log10(counts + 1), at)), pa.array(found), pa.array([len(b) for b in bodies], pa.int64())], names=names)

    out = rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, FOUND)
    log_all = F.log10(sums["total"] + sums["distinct"] + F.lit(1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        sums["total"].alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * log_all).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
