"""Byte-pair encoding and decoding with a segment tree.

Reads a tokenizer file of the `tokenizers` library (BPE with word ends over byte-level
symbols: NFC, white space runs to one space, lower case, a split pattern, byte symbols) and
gives the same ids. A piece's adjacent pairs are the leaves of a segment tree holding their
merge ranks; the root yields the leftmost pair of the lowest rank, a merge updates the three
leaves it touches in logarithmic time, and encoding ends when the root holds no rank.

Each distinct piece is encoded once per worker while it stays in a cache of two generations
of at most CACHE_PIECES short pieces. Added tokens are taken out of the raw text first, as
the library does.

Null texts count as empty and have no ids; very long pieces cost n log n. The file is read
on the driver and broadcast (its size is fixed by the vocabulary).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import configure, texts

CACHE_PIECES = 1 << 17
#: Ids whose texts are laid out at once.
DECODE_IDS = 1 << 15
#: Unicode White_Space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed values of the Unicode Character Database: what versions 16 and 17 add that Python's
# tables of version 15.1 lack and the library's have (letters and numbers of 16 as ranges,
# capitals of 16 and 17 as first capital, first small letter, how many in a row).
ADDED_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
ADDED_NUMBERS = [(0x10D40, 0x10D49), (0x16130, 0x16139), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
ADDED_CAPITALS = [
    (0x1C89, 0x1C8A, 1), (0xA7CB, 0x0264, 1), (0xA7CC, 0xA7CD, 1), (0xA7CE, 0xA7CF, 1), (0xA7D2, 0xA7D3, 1), (0xA7D4, 0xA7D5, 1),
    (0xA7DA, 0xA7DB, 1), (0xA7DC, 0x019B, 1), (0x10D50, 0x10D70, 22), (0x16EA0, 0x16EBB, 25),
]
#: Case is mapped character by character, so that a final sigma is like any other.
_SMALL = {a + k: b + k for a, b, n in ADDED_CAPITALS for k in range(n)} | {ord("Σ"): ord("σ")}
_RARE = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")


def _lower(text: str) -> str:
    return (text.translate(_SMALL) if not text.isascii() and _RARE.search(text) else text).lower()


@lru_cache
def _category(first: str) -> str:
    """Letters (L) or numbers (N) as ranges of a character class. The regex module's own table is of a later version."""
    held = [unicodedata.category(chr(c)).startswith(first) for c in range(sys.maxunicode + 1)] + [False]
    for a, b in ADDED_LETTERS if first == "L" else ADDED_NUMBERS:
        held[a : b + 1] = [True] * (b + 1 - a)
    turns = [c for c in range(len(held)) if held[c] != held[c - 1]]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(turns[::2], turns[1::2]))


#: Below it the regex module and the library agree on what is a letter or a number.
_HIGH = re.compile("[\u0500-\U0010ffff]")


@lru_cache
def unsure_characters() -> regex.Pattern[str]:
    """Characters that the regex module takes for a letter or number and the library does not, or the other way round."""
    own = {f: regex.compile(f"[{_category(f)}]") for f in "LN"}
    theirs = {f: regex.compile(rf"\p{{{f}}}") for f in "LN"}
    found = [c for c in map(chr, range(0x500, sys.maxunicode + 1)) if any((own[f].match(c) is None) != (theirs[f].match(c) is None) for f in "LN")]
    return regex.compile("[" + "".join(found) + "]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class SegmentTree:
    """Ranks of adjacent pairs. Every node holds the least (rank, place) below it as one number, so the root is the leftmost pair of the lowest rank."""

    def __init__(self, ranks: list[int | None]) -> None:
        self.width = 1 << max(0, (len(ranks) - 1).bit_length())
        self.place = self.width.bit_length()  # low bits that hold a place
        self.none = none = 1 << self.place + 38  # a leaf whose pair can't be merged
        low = [none] * (2 * self.width)
        for place, rank in enumerate(ranks, self.width):
            if rank is not None:
                low[place] = rank << self.place | (place - self.width)
        for k in range(self.width - 1, 0, -1):
            a, b = low[2 * k], low[2 * k + 1]
            low[k] = a if a < b else b
        self.low = low

    def top(self) -> tuple[int, int] | None:
        """(rank, place) of the leftmost lowest pair, None if no pair can be merged."""
        root = self.low[1]
        return None if root == self.none else (root >> self.place, root & ((1 << self.place) - 1))

    def put(self, place: int, rank: int | None) -> None:
        low, k = self.low, place + self.width
        low[k] = new = self.none if rank is None else rank << self.place | place
        while k > 1:
            beside = low[k ^ 1]
            if beside < new:
                new = beside
            k >>= 1
            if low[k] == new:  # nothing changes further up
                return
            low[k] = new


class Young(dict[str, bytes]):
    """Pieces met of late with their ids. Pieces that are here cost no call of Python."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        return self.codec._missed(piece)


class Codec:
    def __init__(self, raw: str) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.pieces = regex.compile(self.pattern)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.names = {i: x for x, i in [*self.vocab.items(), *self.added.items()]}
        symbols = byte_symbols()
        self.inner, self.last = [self.vocab[s] for s in symbols], [self.vocab[s + self.end] for s in symbols]
        # Two generations: what the older one holds moves up when it is met again.
        self.old: dict[str, bytes] = {}
        self.young = Young(self)
        spaced = [(self.names.get(i, "") + " ").encode() for i in range(max(self.names) + 1)]
        self.shown = np.frombuffer(b"".join(spaced), np.uint8)
        self.width = np.array([len(x) for x in spaced])
        self.begin = np.cumsum(self.width) - self.width

    @cached_property
    def exact_pieces(self) -> regex.Pattern[str]:
        """The split pattern with letters and numbers spelt out: much slower, for texts with characters of UNSURE."""
        pattern = self.pattern
        for first in "LN":
            pattern = pattern.replace(rf"[\p{{{first}}}]", f"[{_category(first)}]").replace(rf"\p{{{first}}}", _category(first))
        return regex.compile(pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by rank order merges."""
        ids = [self.inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        n = len(ids)
        ranks, merged = self.ranks, self.merged
        found = list(map(ranks.get, zip(ids, ids[1:])))
        if n < 3:
            return [merged[found[0]]] if n == 2 and found[0] is not None else ids
        tree = SegmentTree(found)
        low, width, place, none = tree.low, tree.width, tree.place, tree.none
        mask, known = (1 << place) - 1, ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # As SegmentTree.top and put do, without their calls.
        while (root := low[1]) != none:
            at = root & mask
            gone = after[at]
            ids[at], ids[gone] = new, _ = merged[root >> place], -1
            right, left = after[gone], before[at]
            after[at] = right
            own = none
            changed = []
            if right < n:
                before[right] = at
                changed.append((gone + width, none))
                rank = known((new, ids[right]))
                if rank is not None:
                    own = rank << place | at
            changed.append((at + width, own))
            if left >= 0:
                rank = known((ids[left], new))
                changed.append((left + width, none if rank is None else rank << place | left))
            for k, least in changed:
                if low[k] == least:
                    continue
                low[k] = least
                while k > 1:
                    beside = low[k ^ 1]
                    if beside < least:
                        least = beside
                    k >>= 1
                    if low[k] == least:
                        break
                    low[k] = least
        return [i for i in ids if i >= 0]

    def cut(self, text: str) -> list[str]:
        """Normalised pieces of a text without added tokens."""
        low = _lower(unicodedata.normalize("NFC", text))
        unsure = _HIGH.search(low) is not None and unsure_characters().search(low) is not None
        return (self.exact_pieces if unsure else self.pieces).findall(low)

    def _missed(self, piece: str) -> bytes:
        """Ids of a piece that is not in the younger generation."""
        found = self.old.get(piece)
        if found is None:
            ids = self.merge(piece.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.young) >= CACHE_PIECES:
                self.old = dict(self.young)
                self.young.clear()
            self.young[piece] = found
        return found

    def coded(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.special.split(text) if self.special is not None and "<|" in text else [text]
        found: list[bytes] = []
        for part in parts:
            if part in self.added:
                found.append(struct.pack("<I", self.added[part]))
            else:
                found += map(self.young.__getitem__, self.cut(part))
        return b"".join(found)

    def decoded(self, coded: bytes) -> bytes:
        """The text of ids in UTF-8: their tokens with a space between (the file names no decoder), special tokens included."""
        ids, out = np.frombuffer(coded, "<u4"), []
        for lo in range(0, len(ids), DECODE_IDS):
            part = ids[lo : lo + DECODE_IDS]
            n = self.width[part]
            out.append(self.shown[np.repeat(self.begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        return b"".join(out)[:-1]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.coded(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decoded(np.array(ids, "<u4").tobytes()).decode()


@lru_cache(maxsize=4)
def codec(raw: str) -> Codec:
    return Codec(raw)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encoded(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 (of ids as little-endian unsigned 32-bit integers), decoded, decoded_sha256. Without `ids` neither ids nor the decoded text are handed back."""
    spark = docs.sparkSession
    configure(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(shared.value)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            out["doc_id"] = batch.column("doc_id")
            for text in batch.column("text"):
                coded = known.coded(text.as_py() or "")
                decoded = known.decoded(coded)
                out["n_tokens"].append(len(coded) // 4)
                out["ids_sha256"].append(hashlib.sha256(coded).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    out["ids"].append(np.frombuffer(coded, "<i4"))
                    out["decoded"].append(decoded.decode())
            yield pa.RecordBatch.from_arrays([out[k] if k == "doc_id" else pa.array(out[k], kinds[k]) for k in kinds], [*kinds])

    more = ", ids array<int>, decoded string" if ids else ""
    return texts(docs).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
