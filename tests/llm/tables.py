"""Small tables with the awkward rows every operator must take, and a brute-force union-find."""

from __future__ import annotations

AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "The quick brown fox jumps over the lazy dog and then some more words follow here"),
    (5, "The quick brown fox jumps over the lazy dog and then some more words follow here"),
    (5, "The quick brown fox jumps over the lazy dog and then some more words follow here"),
    (6, "ünïcödé ÄÖÜ ß 漢字 😀 It's 42"),
    (7, "a"),
    (8, "word " * 30000),
    (None, "no id at all in this row"),
    (None, None),
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3)


def clashing(docs):
    """The same table with columns that have the names operators use inside."""
    from pyspark.sql import functions as F

    names = ["fp", "shard", "slot", "size", "key", "rest", "root", "node", "score", "batch", "n", "text_crc32", "word", "c", "b", "part", "ids", "g", "tag", "n_bytes", "n_removed", "n_spans", "kept_text", "n_words", "spans", "items", "matches", "held_out", "known", "id", "hash", "place", "whole", "meta.src"]
    return docs.withColumns({x: F.lit("clash") for x in names})


def least_reachable(ids, linked):
    """The smallest id that each can reach, by plain search."""
    parent = {x: x for x in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in ids}
