"""Token counts by a linear longest-match automaton.

Words (runs of bytes other than space and \\t \\n \\v \\f \\r) are cut greedily into the longest
vocabulary pieces: a first piece from the pieces that open a word, then pieces that continue
one. A trie over both kinds has failure links: where no child fits, the automaton pops the
pieces that the longest-match rule has settled and goes on from the link, reading no byte
twice. How many pieces each link pops is computed with the trie, so a word's count is a sum
over links and no piece is ever built. A word that no opening piece fits opens with a piece
that continues words. A word that can't be cut is one unknown token.

The vocabulary is a file of byte pieces with ranks; pieces that start with a space open
words, the others continue them. It is read on the driver and broadcast (a fixed size).
Distinct words are counted once per worker, in a cache of at most CACHE_WORDS words.

Null and empty texts have no words and no tokens. Whole texts count, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import buffer_of, configure, texts

CACHE_WORDS = 1 << 18


class LongestMatch:
    def __init__(self, openers: Iterable[bytes], continuers: Iterable[bytes]) -> None:
        # Nodes 0 and 1 are the roots for first and for later pieces.
        self.child: dict[int, int] = {}
        parent, byte, token = [-1, -1], [0, 0], [False, False]
        levels: list[list[int]] = []
        for root, pieces in ((0, openers), (1, continuers)):
            for piece in pieces:
                node = root
                for depth, b in enumerate(piece):
                    key = node << 8 | b
                    after = self.child.get(key)
                    if after is None:
                        after = self.child[key] = len(parent)
                        parent.append(node), byte.append(b), token.append(False)
                        if depth == len(levels):
                            levels.append([])
                        levels[depth].append(after)
                    node = after
                if node != root:
                    token[node] = True
        self.link, self.pops = [-1] * len(parent), [0] * len(parent)
        for level in levels:
            for node in level:
                if token[node]:
                    self.link[node], self.pops[node] = 1, 1
                    continue
                up = parent[node]
                to, popped = self.link[up], self.pops[up]
                while to >= 0 and (to << 8 | byte[node]) not in self.child:
                    popped += self.pops[to]
                    to = self.link[to]
                if to >= 0:
                    self.link[node], self.pops[node] = self.child[to << 8 | byte[node]], popped
        self.token = token
        self.cache: dict[bytes, int] = {}

    def opens(self, word: bytes) -> bool:
        """Whether an opening piece fits."""
        node = 0
        for b in word:
            node = self.child.get(node << 8 | b)
            if node is None:
                return False
            if self.token[node]:
                return True
        return False

    def count(self, word: bytes, root: int = 0) -> int:
        """Pieces of a word from a root on, or 0 if it can't be cut."""
        child, link, pops = self.child, self.link, self.pops
        node, n = root, 0
        for b in word:
            while (after := child.get(node << 8 | b)) is None:
                n += pops[node]
                node = link[node]
                if node < 0:
                    return 0
            node = after
        while node != 1:
            n += pops[node]
            node = link[node]
            if node < 0:
                return 0
        return n

    def counted(self, word: bytes) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self.count(word)
            if not found and not self.opens(word):
                found = self.count(word, 1)
            if len(word) <= 64:
                self.cache[word] = found
        return found


def pieces_of(ranks: str) -> tuple[list[bytes], list[bytes]]:
    """Opening and continuing pieces of a file of `base64 rank` lines."""
    pieces = [base64.b64decode(line.split()[0]) for line in ranks.splitlines() if line.strip()]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "]


@lru_cache(maxsize=2)
def automaton(ranks: str) -> LongestMatch:
    return LongestMatch(*pieces_of(ranks))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words count as one) and n_unknown of every document."""
    spark = docs.sparkSession
    configure(spark)
    with open(path or default_path(), encoding="ascii") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = automaton(shared.value).counted
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            body, at = data.tobytes(), offsets.tolist()
            words, tokens, unknown = [], [], []
            for a, b in zip(at, at[1:]):
                found = list(map(counted, body[a:b].split()))
                words.append(len(found)), unknown.append(found.count(0))
                tokens.append(sum(found) + unknown[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
