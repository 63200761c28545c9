"""Exact substring deduplication by depth-limited radix sorting of suffixes.

Removes every byte that a string of `depth` bytes covers which also starts in a document with
a smaller id. Suffixes are compared through their first `depth` bytes only: most-significant-
digit passes of eight bytes split groups of suffixes that agree so far, suffixes left alone
drop out, and the groups left after the last pass are exactly the repeated windows.

So that a corpus need not sort all its suffixes in one place, windows are dealt to buckets by
content: by the window's minimizer, the `k`-byte string in it with the smallest hash. Equal
windows have equal minimizers and meet in one bucket; neighbouring windows share theirs and
travel as one span of bytes. Steps, all over groups of documents of about GROUP_BYTES:

1. Documents whose whole text a smaller id has too are known from a digest alone: all their
   windows repeat. They send nothing.
2. Each group sends the hashes of its minimizers (once each), hashed into buckets; buckets
   answer with those that occur in two documents. Nothing else can be a repeat.
3. Each group sends the spans around those minimizers, equal spans once with their smallest
   id. Buckets sort the windows of their spans as above and answer, for each span, which
   windows have a smaller id elsewhere.
4. Each group marks the bytes covered and cuts them out.

A passage that a third of all documents share is sent once per group. A string shorter than a
window that many share stands in as many contexts; windows around such hot minimizers are
dealt by half of the context too. Groups and buckets are as many as the text needs.

Null texts count as empty; texts shorter than `depth` have no windows. A null id counts as
larger than any other. Rows of equal id don't remove from each other, repeated rows included.
An empty table gives no rows. Other columns, whatever their names, come through unchanged.
Equal spans are told by 128 bits of two hashes; windows of different spans by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import PIECE_BYTES, aside, back, buffer_of, mix64, pieces, redotted, release_memory, span_hashes, undotted, written

DEPTH = 50
GROUP_BYTES = 4 << 20
#: Buckets of spans for each group: a window takes a dozen times its share of memory while it is sorted.
SPAN_BUCKETS = 4
#: A minimizer that more groups have is hot: the string may be shorter than a window and stand in any number of contexts, so windows around it are dealt by their context too.
HOT_GROUPS = 32
#: Windows of a bucket that are sorted at once.
SORT_WINDOWS = 1 << 18
_INDEX = np.uint64(40)  # a key's low bits hold a position, its high ones the hash that ranks it
_LAST_ID = np.int64(2**63 - 1)


def minimizer_length(depth: int) -> int:
    """k such that a window has at most 64 places for it, about half the depth where that is enough."""
    if depth < 16:
        raise ValueError("depth must be at least 16")
    return max(8, depth // 2 - 1, depth - 63)


def _segment_anchors(data: np.ndarray, valid: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(hash, first window, windows, place) of each minimizer of consecutive valid windows in some bytes."""
    k = minimizer_length(depth)
    width, n = depth - k + 1, len(data) - k + 1
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
    h = np.zeros(n, np.uint64)
    for at in [*range(0, k - 8, 8), k - 8]:
        h = (h ^ x[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    low = (h & ~((np.uint64(1) << (np.uint64(64) - _INDEX)) - np.uint64(1))) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    place = (low & ((np.uint64(1) << (np.uint64(64) - _INDEX)) - np.uint64(1))).astype(np.int64)
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, np.uint64), at, at, at
    place = place[at]
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    return h[place[first]], at[first], np.diff(np.append(first, len(at))), place[first]


def anchors(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(hash, row, first window, windows, place) of all minimizers of a buffer of documents."""
    found = []
    for lo, hi in pieces(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        valid = np.ones(max(0, b - a - depth + 1), bool)
        for end in offsets[lo + 1 : hi].tolist():
            valid[max(0, end - a - depth + 1) : end - a] = False
        # A long document goes in segments that overlap by what a window needs.
        for s in range(0, len(valid), PIECE_BYTES):
            h, first, n, place = _segment_anchors(data[a + s : a + s + PIECE_BYTES + depth - 1], valid[s : s + PIECE_BYTES], depth)
            found.append((h, first + a + s, n, place + a + s))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    h, first, n, place = (np.concatenate(x) for x in zip(*found))
    return h, np.searchsorted(offsets, first, "right") - 1, first, n, place


def _is_in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


class Group:
    """Documents of one group: their bytes, ids, minimizers, and those known as copies."""

    def __init__(self, docs: pa.Table, known: pa.Table, depth: int) -> None:
        self.docs, self.depth = docs, depth
        self.data, self.offsets = buffer_of(docs.column("text"))
        self.ids = docs.column("doc_id").fill_null(int(_LAST_ID)).to_numpy().astype(np.int64)
        copied = {(r["o"], r["tag"]) for r in known.filter(pc.equal(known.column("kind"), 0)).select(["o", "tag"]).to_pylist()}
        tags = docs.column("__tag").to_pylist()
        self.copies = np.array([(o, t) in copied for o, t in zip(self.ids.tolist(), tags)], bool) if copied else np.zeros(len(tags), bool)
        h, row, first, n, place = anchors(self.data, self.offsets, depth)
        own = ~self.copies[row]
        self.hash, self.row, self.first, self.n = h[own], row[own], first[own], n[own]
        self.split = np.zeros(len(self.hash), bool)
        hot = _array(known.filter(pc.equal(known.column("kind"), 3)).column("hash"), np.uint64)
        if hot:
            self._split(_is_in(self.hash, np.unique(np.concatenate(hot))), place[own])

    def _split(self, hot: np.ndarray, place: np.ndarray) -> None:
        """Parts the windows around hot minimizers in two, by whether more of the window lies to the left or to the right of it, and adds that context to the hash."""
        k = minimizer_length(self.depth)
        half = (self.depth - k + 1) // 2
        h, row, first, n, place = self.hash[hot], self.row[hot], self.first[hot], self.n[hot], place[hot]
        left = np.clip(place - half + 1 - first, 0, n)
        sides = []
        for begin, size, a, b, odd in (
            (first, left, place - half, place, 0xA24BAED4963EE407),
            (first + left, n - left, place + k, place + self.depth - half + 1, 0x9FB21C651E98DF25),
        ):
            live = np.flatnonzero(size)
            sides.append((mix64(h[live] * np.uint64(odd) + self.digests(row[live], a[live], b[live])), row[live], begin[live], size[live], np.ones(len(live), bool)))
        sides.append((self.hash[~hot], self.row[~hot], self.first[~hot], self.n[~hot], np.zeros(int((~hot).sum()), bool)))
        h, row, first, n, split = (np.concatenate(x) for x in zip(*sides))
        order = np.argsort(first, kind="stable")
        self.hash, self.row, self.first, self.n, self.split = h[order], row[order], first[order], n[order], split[order]

    def digests(self, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes, their rows ascending."""
        out, ranges = np.zeros(len(row), np.uint64), list(pieces(self.offsets))
        cut = np.searchsorted(row, [lo for lo, _ in ranges] + [len(self.offsets)])
        for (lo, hi), a, b in zip(ranges, cut, cut[1:]):
            if a < b:
                base = self.offsets[lo]
                out[a:b] = span_hashes(self.data[base : self.offsets[hi]], starts[a:b] - base, ends[a:b] - base)
        return out

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers in order, and which of them documents of two ids have."""
        order = np.argsort(self.hash, kind="stable")
        h, ids = self.hash[order], self.ids[self.row[order]]
        run = _runs(h)
        if not len(run):
            return h, np.zeros(0, bool)
        return h[run], np.minimum.reduceat(ids, run) != np.maximum.reduceat(ids, run)

    def spans(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchors whose hash is wanted or split, sorted by hash, digest and id; their digests; where runs of equal spans start)."""
        at = np.flatnonzero(self.split | _is_in(self.hash, wanted))
        digest = self.digests(self.row[at], self.first[at], self.first[at] + self.n[at] + self.depth - 1)
        order = np.lexsort((self.ids[self.row[at]], digest, self.hash[at]))
        at, digest = at[order], digest[order]
        return at, digest, _runs(self.hash[at], digest) if len(at) else at


def _digits(data: np.ndarray, starts: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes from `at` on of each window, the first one highest; bytes past the end count as those of the end."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(at, at + 8):
        out = (out << np.uint64(8)) | data[np.minimum(starts + k, len(data) - 1)]
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of equal windows among data[s : s + depth], by most-significant-digit passes: (windows in order, where groups start), groups of at least two."""
    window, label = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for at in range(0, depth, 8):
        digit = _digits(data, starts[window], at) >> np.uint64(8 * max(0, 8 - (depth - at)))
        order = np.lexsort((digit, label))
        window, label, digit = window[order], label[order], digit[order]
        run = _runs(label, digit) if len(window) else window
        size = np.diff(np.append(run, len(window)))
        kept = np.repeat(size > 1, size)
        window, label = window[kept], np.repeat(np.arange(len(run)), size)[kept]
    return window, _runs(label) if len(window) else window


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _array(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)], schema=schema)


_HASHES = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("one", pa.binary()), ("many", pa.binary())])
_SPANS = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("hash", pa.binary()), ("digest", pa.binary()), ("id", pa.binary()), ("n", pa.binary()), ("body", pa.binary())])
_KNOWN = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("o", pa.int64()), ("tag", pa.int64()), ("hash", pa.binary()), ("digest", pa.binary()), ("mask", pa.binary())])
_KNOWN_DDL = "g long, kind int, o long, tag long, hash binary, digest binary, mask binary"


def _send_hashes(docs: pa.Table, known: pa.Table, depth: int, n: int) -> pa.Table:
    if not docs.num_rows:
        return _table([], _HASHES)
    g, (h, many) = docs.column("__g")[0].as_py(), Group(docs, known, depth).repeated()
    bucket = _buckets(h, n)
    run = _runs(bucket) if len(h) else []
    return _table([(int(bucket[a]), g, h[a:b][~many[a:b]].tobytes(), h[a:b][many[a:b]].tobytes()) for a, b in zip(run, [*run[1:], len(h)])], _HASHES)


def _match_hashes(sent: pa.Table, hot_groups: int) -> pa.Table:
    """To each group: its minimizers that documents of two ids have (kind 1), and those of over hot_groups groups (kind 3)."""
    groups = sent.column("g").to_numpy()
    one, many = _array(sent.column("one"), np.uint64), _array(sent.column("many"), np.uint64)
    h = np.concatenate([*one, *many])
    owner = np.repeat(np.tile(np.arange(len(groups)), 2), [len(x) for x in [*one, *many]])
    sure = np.repeat([False, True], [sum(map(len, one)), sum(map(len, many))])
    order = np.argsort(h, kind="stable")
    h, owner, sure = h[order], owner[order], sure[order]
    run = _runs(h)
    size = np.diff(np.append(run, len(h)))
    shared = np.repeat((size > 1) | np.logical_or.reduceat(sure, run), size) if len(h) else sure
    hot = np.repeat(size > hot_groups, size)
    out = []
    for kind, chosen in ((1, shared & ~hot), (3, hot)):
        to, mine = owner[chosen], h[chosen]
        order = np.argsort(to, kind="stable")
        to, mine = to[order], mine[order]
        run = _runs(to) if len(to) else []
        out += [(int(groups[to[a]]), kind, None, None, mine[a:b].tobytes(), None, None) for a, b in zip(run, [*run[1:], len(to)])]
    return _table(out, _KNOWN)


def _send_spans(docs: pa.Table, known: pa.Table, depth: int, n: int) -> pa.Table:
    if not docs.num_rows:
        return _table([], _SPANS)
    g, group = docs.column("__g")[0].as_py(), Group(docs, known, depth)
    wanted = _array(known.filter(pc.equal(known.column("kind"), 1)).column("hash"), np.uint64)
    at, digest, run = group.spans(np.unique(np.concatenate([np.zeros(0, np.uint64), *wanted])))
    at, digest = at[run], digest[run]
    bucket = _buckets(group.hash[at], n)
    cut = _runs(bucket) if len(at) else []
    out = []
    for a, b in zip(cut, [*cut[1:], len(at)]):
        x = at[a:b]
        size = group.n[x] + depth - 1
        body = group.data[np.repeat(group.first[x] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        out.append((int(bucket[a]), g, group.hash[x].tobytes(), digest[a:b].tobytes(), group.ids[group.row[x]].tobytes(), group.n[x].astype(np.uint8).tobytes(), body.tobytes()))
    return _table(out, _SPANS)


def _sort_spans(sent: pa.Table, depth: int) -> pa.Table:
    """To each group: for its spans, the windows that start in a document with a smaller id elsewhere, as bits."""
    groups = sent.column("g").to_numpy()
    parts = {c: _array(sent.column(c), kind) for c, kind in (("hash", np.uint64), ("digest", np.uint64), ("id", np.int64), ("n", np.uint8), ("body", np.uint8))}
    owner = np.repeat(np.arange(len(groups)), [len(x) for x in parts["hash"]])
    h, digest, ids, n, data = (np.concatenate(parts[c]) for c in ("hash", "digest", "id", "n", "body"))
    n = n.astype(np.int64)
    place = np.cumsum(n + depth - 1) - (n + depth - 1)
    order = np.lexsort((ids, digest, h))
    run = _runs(h[order], digest[order])
    which = np.empty(len(h), np.int64)  # of each record: its distinct span
    which[order] = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(h))))
    first = order[run]  # the record with the smallest id of each distinct span
    size = n[first]
    begin = np.cumsum(size) - size  # of each distinct span: its first window
    starts = np.repeat(place[first] - begin, size) + np.arange(size.sum())
    least = np.repeat(ids[first], size)
    # Equal windows begin alike, so parts by a hash of the first bytes can be sorted one after another.
    parts = len(starts) // SORT_WINDOWS + 1
    part = (mix64(_digits(data, starts, 0)) % np.uint64(parts)).astype(np.uint16) if parts > 1 else np.zeros(len(starts), np.uint16)
    for k in range(parts):
        mine = np.flatnonzero(part == k)
        window, group = repeated_windows(data, starts[mine], depth)
        if len(group):
            window = mine[window]
            low = np.minimum.reduceat(least[window], group)
            least[window] = np.repeat(low, np.diff(np.append(group, len(window))))
    # Each record's windows: those whose smallest id is below its own, a bit each.
    mask = np.zeros(len(n), np.uint64)
    for j in range(int(n.max(initial=0))):
        rows = np.flatnonzero(n > j)
        mask[rows] |= (least[begin[which[rows]] + j] < ids[rows]).astype(np.uint64) << np.uint64(j)
    live = np.flatnonzero(mask)
    run = _runs(owner[live]) if len(live) else []
    return _table([(int(groups[owner[live[a]]]), 2, None, None, h[live[a:b]].tobytes(), digest[live[a:b]].tobytes(), mask[live[a:b]].tobytes()) for a, b in zip(run, [*run[1:], len(live)])], _KNOWN)


def covered(group: Group, known: pa.Table) -> np.ndarray:
    """Which bytes of a group go."""
    depth, cover = group.depth, np.zeros(len(group.data) + 1, np.int32)
    answer = known.filter(pc.equal(known.column("kind"), 2))
    h, digest, mask = (np.concatenate([np.zeros(0, np.uint64), *_array(answer.column(c), np.uint64)]) for c in ("hash", "digest", "mask"))
    own, many = group.repeated()
    at, found, run = group.spans(np.union1d(own[many], h))
    if len(at):
        # Answers are for the smallest id of each span in the group; all windows of larger ids repeat.
        span = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(at))))
        key = np.sort(np.rec.fromarrays([h, digest, mask], names="h,d,m"), order=["h", "d"]) if len(h) else None
        bits = np.zeros(len(run), np.uint64)
        if key is not None:
            pairs = np.concatenate([np.column_stack([key["h"], key["d"]]), np.column_stack([group.hash[at[run]], found[run]])])
            _, code = np.unique(pairs, axis=0, return_inverse=True)
            value = np.zeros(code.max() + 1, np.uint64)
            value[code.reshape(-1)[: len(h)]] = key["m"]
            bits = value[code.reshape(-1)[len(h) :]]
        ids = group.ids[group.row[at]]
        later = ids > ids[run][span]
        np.add.at(cover, group.first[at[later]], 1)
        np.add.at(cover, group.first[at[later]] + group.n[at[later]] + depth - 1, -1)
        same, live = at[~later], bits[span[~later]]
        same, live = same[live > 0], live[live > 0]
        for j in range(64):
            s = group.first[same[(live >> np.uint64(j)) & np.uint64(1) > 0]] + j
            np.add.at(cover, s, 1)
            np.add.at(cover, s + depth, -1)
    gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
    for k in np.flatnonzero(group.copies).tolist():
        a, b = group.offsets[k], group.offsets[k + 1]
        if b - a >= depth:
            gone[a:b] = True
    return gone


def _cut(docs: pa.Table, known: pa.Table, depth: int, columns: list[str], schema: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    group = Group(docs, known, depth)
    gone = covered(group, known)
    n_removed, n_spans, digest, kept_text = [], [], [], []
    for k, (a, b) in enumerate(zip(group.offsets.tolist(), group.offsets[1:].tolist())):
        mine = gone[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
        n_removed.append(int(mine.sum())), n_spans.append(len(edge) // 2)
        body = group.data[a:b]
        digest.append(hashlib.sha256(body[~mine].tobytes()).hexdigest())
        keep = np.concatenate([[0], edge, [b - a]]).reshape(-1, 2).tolist()
        # Characters cut in two go whole.
        kept_text.append("".join(body[x:y].tobytes().decode("utf-8", "ignore") for x, y in keep))
    more = {"n_bytes": np.diff(group.offsets), "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": digest, "kept_text": kept_text}
    return pa.table([docs.column(c).cast(f.type) if c in columns else pa.array(more[c], f.type) for c, f in zip(schema.names, schema)], schema=schema)


ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


#: Names that cut() gives, and how many tasks a text with many copies is looked up in.
NAMES = tuple(x.split()[0] for x in ADDED.split(", "))
SALTS = 16


def cut(docs: DataFrame, depth: int = DEPTH, group_bytes: int = GROUP_BYTES, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept_text (what is left, without characters cut in two). Columns that docs has under these names are replaced; deduplicated() keeps them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    minimizer_length(depth)
    docs, dotted = undotted(docs)
    columns = [c for c in docs.columns if c not in NAMES]
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_bytes = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    n = int(n_bytes // group_bytes) + 1
    tag, order = F.xxhash64(body), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST_ID)))
    g = F.pmod(F.xxhash64("doc_id", tag), F.lit(n))
    rows = docs.select(*columns, tag.alias("__tag"), g.alias("__g")).withColumn("doc_id", F.col("doc_id").cast("long"))

    # Only texts of two ids or more are looked up, each in SALTS places: one that a third of all documents have is no single key.
    light = docs.select(g.alias("g"), order.alias("o"), tag.alias("tag"), F.sha2(body, 256).alias("whole"))
    least = light.groupBy("whole").agg(F.min("o").alias("least"), F.max("o").alias("most")).where("least < most")
    spread = least.select("whole", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = light.withColumn("salt", F.pmod(F.xxhash64("o"), F.lit(SALTS)).cast("int"))
    copies = dealt.join(spread, ["whole", "salt"]).where("o > least").select("g", F.lit(0).alias("kind"), "o", "tag", *(F.lit(None).cast("binary").alias(c) for c in ("hash", "digest", "mask")))
    copies = written(copies.distinct(), "copies")

    def ddl(schema: pa.Schema) -> str:
        return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'binary'}" for f in schema)

    def released(step: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
        def run(*tables: pa.Table) -> pa.Table:
            out = step(*tables)
            release_memory()
            return out

        return run

    one = released(lambda d, k: _send_hashes(d, k, depth, n))
    two = released(lambda t: _match_hashes(t, hot_groups))
    three = released(lambda d, k: _send_spans(d, k, depth, SPAN_BUCKETS * n))
    four = released(lambda t: _sort_spans(t, depth))
    schema = StructType([*rows.select(*columns).schema.fields, *StructType.fromDDL(ADDED).fields])
    arrow = to_arrow_schema(schema)
    five = released(lambda d, k: _cut(d, k, depth, columns, arrow))

    def with_docs(known: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], out: str | StructType) -> DataFrame:
        left, right = rows.groupBy("__g"), known.groupBy("g")
        return left.cogroup(right).applyInArrow(lambda d, k: step(d, k), out)

    # The three passes over the documents share one shuffle of them.
    hashes = with_docs(copies, one, ddl(_HASHES))
    wanted = hashes.groupBy("b").applyInArrow(lambda t: two(t), _KNOWN_DDL)
    spans = with_docs(copies.union(wanted), three, ddl(_SPANS))
    answers = spans.groupBy("b").applyInArrow(lambda t: four(t), _KNOWN_DDL)
    return redotted(with_docs(copies.union(answers).union(wanted.where("kind = 3")), five, schema), dotted)


def deduplicated(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs with the repeated passages cut out of text, and n_chars, where there is one, counted again."""
    out = cut(aside(docs, NAMES), depth).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return back(out, docs.columns, NAMES)
