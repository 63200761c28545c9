"""HTML extraction: a recurrent labeller decides for every block whether it is of the article.

A page is the sequence of its leaf blocks (`blocks.leaves`). A bidirectional LSTM reads, for each
block, the hashed features of its tag path, its hashed words and a few counts, so that what comes
before and after on the whole page bears on each decision. The main text is the blocks labelled so,
in page order, one per line.

The labeller is trained on the driver, from a fixed seed, on PAGES_MADE made-up pages (`layouts`)
and on at most PAGES_READ pages of the corpus (those with the smallest hashes) that have an article
or main element, whose markup then tells the labels; nothing else limits what is read: every page
is extracted whole. The made-up pages are worded with words of those corpus pages.

Defined results: null or empty html, and pages without a block of an article: empty text, 0
characters. Null ids and urls, repeated rows and equal pages: a row each. A table without pages that
tell labels: the made-up pages alone are learned from; empty table: no rows. A page is held whole by the
task that reads it, however long. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import PATH_FEATURES, Leaf, leaves
from quern.llm.common import ALNUM, LOWER, configure, rows_of, span_hashes, word_spans
from quern.llm.layouts import Layouts
from quern.llm.recurrent import BiLstm

WORD_FEATURES = 32
COUNTS = 6
HIDDEN = 24
EPOCHS = 8
SEED = 12

PAGES_MADE = 1500
PAGES_READ = 300
#: Characters of the pages that the labeller is trained on, at most (longer pages are passed over for training).
READ_CHARS = 20_000

#: Elements whose text is not the article's, inside an article too. Only for labels of corpus pages.
ASIDE = {"nav", "aside", "footer", "form", ".ad", ".ads", ".advert", ".comments", ".comment", ".share", ".related", ".sidebar"}


def features(pages: Sequence[Sequence[Leaf]]) -> list[np.ndarray]:
    """A row of features for each block of each page."""
    flat = [leaf for page in pages for leaf in page]
    x = np.zeros((len(flat), PATH_FEATURES + WORD_FEATURES + COUNTS), np.float32)
    if flat:
        sizes = [len(leaf.path) for leaf in flat]
        x[np.repeat(np.arange(len(flat)), sizes), np.fromiter((s for leaf in flat for s in leaf.path), np.int64, sum(sizes))] = 1
        bodies = [leaf.text.encode() for leaf in flat]
        data, offsets = np.frombuffer(b"".join(bodies), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        low = LOWER[data]
        starts, ends = word_spans(low, offsets, ALNUM)
        rows = rows_of(starts, offsets)
        slots = (span_hashes(low, starts, ends) % np.uint64(WORD_FEATURES)).astype(np.int64)
        n = np.bincount(rows, minlength=len(flat))
        words = np.bincount(rows * WORD_FEATURES + slots, minlength=len(flat) * WORD_FEATURES).reshape(len(flat), -1)
        x[:, PATH_FEATURES:-COUNTS] = words / np.sqrt(np.maximum(n, 1))[:, None]
        chars = np.array([len(leaf.text) for leaf in flat])
        marks = np.bincount(rows_of(np.flatnonzero(np.isin(data, np.frombuffer(b".,;:!?", np.uint8))), offsets), minlength=len(flat))
        x[:, -6] = np.log1p(chars) / 8
        x[:, -5] = np.log1p(n) / 6
        x[:, -4] = np.minimum(1, [leaf.link_chars / max(1, len(leaf.text)) for leaf in flat])
        x[:, -3] = np.minimum(1, marks / np.maximum(n, 1))
        x[:, -2] = ["©" in leaf.text for leaf in flat]
        x[:, -1] = 1
    ends = np.cumsum([len(page) for page in pages])[:-1] if pages else []
    return np.split(x, ends) if pages else []


def marked(page: Sequence[Leaf]) -> np.ndarray | None:
    """Labels of a page that its own markup tells; None if it has no article or main element."""
    labels = [("article" in leaf.names or "main" in leaf.names) and not ASIDE & set(leaf.names) for leaf in page]
    return np.array(labels, float) if any(labels) else None


def trained(html: Sequence[str], made: int = PAGES_MADE, epochs: int = EPOCHS, seed: int = SEED) -> BiLstm:
    """A labeller from corpus pages and made-up ones."""
    pages, labels, words = [], [], []
    for body in html:
        page = leaves(body)
        own = marked(page)
        words += [w for leaf in page for w in leaf.text.split()[:200]]
        if own is not None:
            pages.append(page)
            labels.append(own)
    layouts = Layouts(words, seed)
    for _ in range(made):
        body, told = layouts.page()
        page = leaves(body)
        # Breaks inside a line and markup that ends early may cut a block in two: labels go by the text they belong to.
        own = _matched(page, told)
        if own is not None:
            pages.append(page)
            labels.append(own)
    model = BiLstm(PATH_FEATURES + WORD_FEATURES + COUNTS, HIDDEN, seed)
    model.losses = model.fit(features(pages), labels, epochs, seed)
    return model


def _matched(page: Sequence[Leaf], told: Sequence[tuple[str, bool]]) -> np.ndarray | None:
    """Labels of leaves from the blocks a page was made of; None if they don't line up."""
    labels, at = [], 0
    for leaf in page:
        while at < len(told) and leaf.text not in told[at][0]:
            at += 1
        if at == len(told):
            return None
        labels.append(float(told[at][1]))
    return np.array(labels) if labels else None


def main_texts(html: Sequence[str | None], model: BiLstm) -> list[str]:
    pages = [leaves(body) if body else [] for body in html]
    logits = model.logits(features(pages))
    return ["\n".join(leaf.text for leaf, z in zip(page, score) if z > 0) if page else "" for page, score in zip(pages, logits)]


def training_pages(pages: DataFrame, html: str = "html", limit: int = PAGES_READ) -> list[str]:
    """The bounded sample of corpus pages: smallest hashes first, copies once. Hashes alone are ranked, then the pages that have them are fetched, so that little comes to the driver however many tasks there are."""
    body = F.col(f"`{html}`").cast("string")
    sample = pages.select(body.alias("html")).where(F.length("html").between(1, READ_CHARS)).where(F.lower("html").rlike("<(article|main)[\\s>]"))
    sample = sample.withColumn("hash", F.xxhash64("html"))
    least = [r.hash for r in sample.select("hash").distinct().orderBy("hash").limit(limit).collect()]
    if not least:
        return []
    found = sample.where(F.col("hash") <= least[-1]).dropDuplicates(["html"]).orderBy("hash", "html").limit(limit)
    return [r.html for r in found.collect()]


def extracted(pages: DataFrame, model: BiLstm | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    configure(spark)
    model = model or trained(training_pages(pages))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    sent = spark.sparkContext.broadcast(model.lighter())  # of a fixed size: the weights of one labeller

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = main_texts(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, schema)
