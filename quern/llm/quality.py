"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled
bad. A text is compressed whole, in blocks of BLOCK bytes so that the dictionaries bear on
all of it, with either dictionary. The normalised difference of the two compressed sizes,
together with how far the text compresses at all (a word repeated a thousand times shrinks
to nothing under any dictionary), goes through a logistic calibration to the odds of label 1.

Only labels decide what is learned, and only from rows that are not held out: the fit takes
at most `docs_per_class` documents and `train_bytes` bytes of each class (those with the
smallest hashed ids), half for the dictionaries and half for the calibration; class shares
are counted over all training labels. Lines found in both classes' dictionary texts are left
out of both. Scores use the text alone.

Null and empty texts get the score the calibration gives to nothing compressed (a number
from 0 to 1 like any other). Ids with several labels count as good only if all are. Without
labels of both classes there is no dictionary and every score is the share of good labels
(0.5 without any).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.llm.common import buffer_of, configure, redotted, undotted

BLOCK = 512
LEVEL = 3
DICTIONARY_BYTES = 1 << 16
DOCS_PER_CLASS = 2400
TRAIN_BYTES = 24 << 20
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for rows no label is learned from: crc32 of the id as text leaves 0 modulo FOLDS. A null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def _blocks(body: bytes) -> list[bytes]:
    return [body[k : k + BLOCK] for k in range(0, len(body), BLOCK)]


def _dictionary(samples: list[bytes]) -> bytes:
    parts = [x for s in samples for x in _blocks(s)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little to choose from: the text itself serves
        return b"\n".join(parts)[-DICTIONARY_BYTES:].ljust(8, b"\n")


def _features(sizes: np.ndarray) -> np.ndarray:
    """From (bytes, compressed with the good dictionary, with the bad one): the normalised difference, the ratio and the length, with products."""
    n, good, bad = np.asarray(sizes, np.float64).reshape(-1, 3).T
    gain = (bad - good) / np.maximum(bad + good, 1)
    ratio, length = np.log((good + bad + 2) / (2 * n + 2)), np.log1p(n)
    return np.column_stack([np.ones(len(n)), gain, gain * np.abs(gain), ratio, ratio * ratio, gain * length, gain * ratio, length])


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def sizes(self, bodies: list[bytes]) -> np.ndarray:
        packers = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        good, bad = (p.compress for p in packers)
        out = np.zeros((len(bodies), 3), np.int64)
        for k, body in enumerate(bodies):
            parts = _blocks(body)
            out[k] = len(body), sum(len(good(x)) for x in parts), sum(len(bad(x)) for x in parts)
        return out

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(bodies), self.prior)
        # Summed row by row: a matrix product could round equal texts differently.
        odds = ((_features(self.sizes(bodies)) - self.mean) / self.scale * self.weights).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression (first column: constant, not penalised), by Newton steps."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Trains on the driver from the bounded sample described above."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Labels can cover documents that an earlier step has removed; only those here count.
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi")
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if min(counts.get(0, 0), counts.get(1, 0)) < 4:
        return Model(b"", b"", np.zeros(8), np.ones(8), np.zeros(8), prior)
    bodies: list[list[bytes]] = []
    for quality in (0, 1):
        rank = F.xxhash64("doc_id", F.lit("quality sample"))
        chosen = [r.doc_id for r in known.where(F.col("quality") == quality).orderBy(rank, "doc_id").limit(docs_per_class).collect()]
        rows = docs.where(F.col("doc_id").cast("long").isin(chosen)) if len(chosen) <= 10 else docs.join(F.broadcast(docs.sparkSession.createDataFrame([(c,) for c in chosen], "chosen long")), F.col("doc_id").cast("long") == F.col("chosen"), "left_semi")
        found, held = [], 0
        for r in rows.select(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("body")).orderBy(F.xxhash64("body", "doc_id")).toLocalIterator():
            held += len(r.body)
            if held > train_bytes and len(found) >= 4:
                break
            found.append(bytes(r.body))
        bodies.append(found)
    halves = [(b[::2], b[1::2]) for b in bodies]
    lines = [{x for body in half for x in body.split(b"\n")} for half, _ in halves]
    shared = lines[0] & lines[1]
    own = [[b"\n".join(x for x in body.split(b"\n") if x not in shared) for body in half] for half, _ in halves]
    model = Model(_dictionary(own[1]), _dictionary(own[0]), np.zeros(8), np.ones(8), np.zeros(8), prior)
    x = np.concatenate([_features(model.sizes(halves[q][1])) for q in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(halves[0][1]), len(halves[1][1])])
    model.mean, model.scale = np.r_[0.0, x[:, 1:].mean(axis=0)], np.r_[1.0, np.maximum(x[:, 1:].std(axis=0), 1e-6)]
    model.weights = _logistic((x - model.mean) / model.scale, y)
    # The sample holds both classes alike; the odds are moved to the classes' shares of all training labels.
    model.weights[0] += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores (0 to 1; higher: label 1 likelier). A column of that name is replaced."""
    docs, dotted = undotted(docs)
    spark = docs.sparkSession
    configure(spark)
    shared, rest = spark.sparkContext.broadcast(model), [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            body, at = data.tobytes(), offsets.tolist()
            found = shared.value.scores([body[a:b] for a, b in zip(at, at[1:])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.float64())], [*rest, name])

    kept = docs.select(*rest)
    return redotted(kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, DoubleType())])), dotted)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that score at least the threshold."""
    return scored(docs, fit(docs, labels), "__score").where(F.col("__score") >= threshold).drop("__score")
