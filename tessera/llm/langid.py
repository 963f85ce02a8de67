"""Language identification by a byte convolutional network.

Filters of several widths are max-pooled over fixed-length windows that cover
the whole text, a softmax gives each window's languages, and a text's languages
are the mean of its windows'.  Texts are batched; the network is trained in
numpy on a bounded sample of labelled text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.bytecnn import ByteCNN, as_rows, sample_windows, softmax
from tessera.llm.shared import stored

CELL = 256
WIDTHS, FILTERS = (2, 3, 5), 8
REACH = max(WIDTHS) - 1
#: The bound of the training sample: documents of each language (expected) and windows of each document.
SAMPLE, WINDOWS = 600, 4
#: The bound of the classes, above the number of languages that have a code in common use; and passes over the sample.
CLASSES, EPOCHS = 1000, 12

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def held_out(doc_id: str = "doc_id"):
    """Documents that languages are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches):
        windows, owner = sample_windows(block.data, block.offsets, CELL + REACH, WINDOWS)
        yield pa.RecordBatch.from_arrays([block.batch.column(0).take(pa.array(owner, pa.int64())), pa.array(windows, pa.binary())], names=["lang", "window"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = CLASSES) -> tuple[ByteCNN, list[str]] | None:
    """A model from documents with a language that are not held out; None without any.

    The `most` most frequent languages are classes, all of them in any real corpus: a column of more values holds
    something else, and no network tells that many apart.  Of each about `sample` documents are chosen by a hash of
    their ids; the driver receives their windows only.
    """
    known = docs.where(~held_out(doc_id)).where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("own_id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n_classes = counts.count()
    if n_classes > most:
        counts = stored(counts.orderBy(F.desc("n"), "lang").limit(most), "languages")
    # At most `most` rows, whatever the column holds.
    names = sorted(r["lang"] for r in counts.select("lang").collect())
    if not names:
        return None
    share = counts.select(F.col("lang").alias("name"), F.least(F.lit(1.0), sample / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("own_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = known.join(F.broadcast(share), F.col("lang") == F.col("name")).where(place < F.col("share")).select("lang", "text").where("text <> ''")
    # At most about `sample` documents of each language and WINDOWS windows of each.
    found = rows.mapInArrow(_windows, "lang string, window binary").toPandas().sort_values(["lang", "window"])
    if not len(found):
        return None
    model = ByteCNN.new(CELL, WIDTHS, FILTERS, len(names))
    y = found["lang"].map({name: k for k, name in enumerate(names)}).to_numpy(np.int64)
    model.train(as_rows([bytes(w) for w in found["window"]], CELL + REACH), y, epochs=EPOCHS)
    return model, names


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, names = model.value
        for block in tb.blocks(batches, limit=tb.BLOCK_BYTES // 2):
            pooled, cells = network.pool(block.data, block.offsets)
            starts = np.cumsum(cells) - cells
            chance = np.add.reduceat(softmax(network.logits(pooled)), starts, axis=0) / cells[:, None]
            best = chance.argmax(1)
            lang, score = [], []
            for k in range(len(block)):
                known = _LETTER[block.data[block.offsets[k] : block.offsets[k + 1]]].any() or any(c.isalpha() for c in block.doc(k).decode())
                lang.append(names[best[k]] if known else "und")
                score.append(min(1.0, float(chance[k, best[k]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([block.batch.column(0), block.batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is `und` with score 0, and so is every
    text when no language can be learned.  Rows with a null language are scored
    but not learned from; a null doc_id is neither held out nor learned from.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    model = fit(docs, doc_id, text, lang, sample)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")
