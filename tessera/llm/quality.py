"""Document quality by a byte-level convolutional network.

Filters are pooled over chunks of two neighbouring cells, so that chunks overlap
by half and together cover the whole document; chunk scores are combined into
one probability by a logistic layer over their mean and their minimum.  The
network is fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.bytecnn import ByteCNN, as_rows, sample_windows
from tessera.llm.shared import free_names

CELL = 256
WIDTH, FILTERS = 6, 16
#: The bound of the training sample: documents of each label, and windows of each document.
SAMPLE, WINDOWS = 1500, 6
#: How often the sample's windows of the rarer label are repeated at most, which bounds the training.
MOST_REPEATS = 8


def held_out(doc_id: str = "doc_id"):
    """Documents that labels are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches):
        windows, owner = sample_windows(block.data, block.offsets, CELL + WIDTH - 1, WINDOWS)
        owner = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([block.batch.column(0).take(owner), block.batch.column(1).take(owner), pa.array(windows, pa.binary())], names=["doc_id", "quality", "window"])


def _combine(chance: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean and minimum over each document's chunks."""
    starts = np.cumsum(counts) - counts
    return np.stack([np.add.reduceat(chance, starts) / counts, np.minimum.reduceat(chance, starts)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights (last one the bias) by gradient descent, labels weighted alike."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    out = np.array([1.0, 0.0, 0.0])
    for _ in range(steps):
        out -= 0.5 * x.T @ (weight * (1 / (1 + np.exp(-x @ out)) - y))
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[ByteCNN, np.ndarray] | None:
    """A model from labelled documents that are not held out; None without both labels.

    At most `sample` documents of each label, those with the smallest hashes of
    their ids, and WINDOWS windows of each reach the driver.
    """
    known = labels.where(~held_out()).where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("_id"), "quality").distinct()
    chosen = [known.where(F.col("quality") == label).orderBy(F.xxhash64("_id"), "_id").limit(sample) for label in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(chosen, rows["doc_id"] == chosen["_id"]).select("doc_id", F.col("quality").cast("int"), "text")
    found = rows.mapInArrow(_windows, "doc_id long, quality int, window binary").toPandas()
    if found["quality"].nunique() < 2:
        return None
    found = found.sort_values(["doc_id", "window"])
    y = found["quality"].to_numpy(np.int64)
    windows = as_rows([bytes(w) for w in found["window"]], CELL + WIDTH - 1)
    model = ByteCNN.new(CELL, (WIDTH,), FILTERS, 2)
    # Windows of the rarer label are repeated until both have about as many; one of less than MOST_REPEATS times fewer windows stays rarer.
    rare = int((y == 1).sum() < (y == 0).sum())
    repeats = np.where(y == rare, max(1, round((y != rare).sum() / (y == rare).sum())), 1)
    order = np.repeat(np.arange(len(y)), np.minimum(repeats, MOST_REPEATS))
    model.train(windows[order], y[order])
    lengths = np.array([len(w) for w in found["window"]])
    flat = np.frombuffer(b"".join(found["window"]), np.uint8)
    chance = []
    for at in range(0, len(lengths), 512):
        part = np.concatenate([[0], np.cumsum(lengths[at : at + 512])])
        start = int(lengths[:at].sum())
        pooled, cells = model.pool(flat[start : start + part[-1]], part)
        chance.append(_scores(model, np.maximum.reduceat(pooled, np.cumsum(cells) - cells, axis=0)))
    counts = found.groupby("doc_id", sort=True).size().to_numpy()
    owner = np.cumsum(counts) - counts
    return model, _logistic(_combine(np.concatenate(chance), counts), y[owner])


def _scores(model: ByteCNN, pooled: np.ndarray) -> np.ndarray:
    """Log odds of quality, bounded."""
    scores = model.logits(pooled)
    return np.clip(scores[:, 1] - scores[:, 0], -8, 8)


def _score(model, text: str = "text", column: str = "score"):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, weights = model.value
        for block in tb.blocks(batches, text, tb.BLOCK_BYTES // 2):
            pooled, cells = network.pool(block.data, block.offsets)
            # A chunk is a cell and its successor in the same text; a text's only cell is a chunk too.
            last = np.cumsum(cells) - 1
            chunks = pooled.copy()
            inner = np.ones(len(pooled), bool)
            inner[last] = False
            inner = np.flatnonzero(inner)
            chunks[inner] = np.maximum(pooled[inner], pooled[inner + 1])
            keep = np.ones(len(pooled), bool)
            keep[last[cells > 1]] = False
            x = _combine(_scores(network, chunks[keep]), np.maximum(1, cells - 1))
            chance = 1 / (1 + np.exp(-(x @ weights[:2] + weights[2])))
            rest = block.batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(chance)], names=[*rest.schema.names, column])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Every byte of every text is scored; null and empty texts are scored as an
    empty chunk.  Labels other than 0 and 1 are not used.  Without both labels
    every score is 0.5.  A null doc_id is not held out.  Extra columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    model = fit(docs, labels, doc_id, text, sample)
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with a score of 0.5 or more, all columns, whatever their names; all rows without both labels."""
    model = fit(docs, labels, doc_id, text)
    if model is None:
        return docs
    whole, score = free_names(docs, "whole_text", "score")
    rows = docs.withColumn(whole, F.coalesce(F.col(text).cast("string"), F.lit("")))
    fields = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), whole, score), f"{fields}, `{score}` double")
    return scored.where(F.col(score) >= 0.5).drop(score)
