"""Line deduplication over the whole corpus.

Lines are exploded with their position, normalised and hashed (128 bits); Spark
counts the distinct documents of each hash after a map-side pre-aggregation, and
lines over the threshold are joined back on the hash.  Only hashes and positions
are shuffled for counting; the texts move once, to be reassembled by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored
from tessera.llm.textblocks import blocks

#: Space and the five ASCII controls from tab to carriage return.
BLANKS = b" \t\n\v\f\r"

_LINES = "doc_id long, text_key long, n_lines long, lines array<struct<place:int,line:binary>>"
_LINE = pa.struct([("place", pa.int32()), ("line", pa.binary())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int64()), ("lines", pa.list_(_LINE))])


def _hash_lines(least: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            counts, sizes, places, digests = [], [], [], []
            for k in range(len(block)):
                lines = block.doc(k).lower().split(b"\n")  # bytes.lower() changes A-Z alone
                counts.append(len(lines))
                before = len(places)
                for place, line in enumerate(lines):
                    key = line.strip(BLANKS)
                    if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                        places.append(place)
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                sizes.append(len(places) - before)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lines = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(digests, pa.binary())], fields=list(_LINE)))
            yield pa.RecordBatch.from_arrays([block.batch.column(0), block.batch.column(1), pa.array(counts, pa.int64()), lines], schema=_SCHEMA)

    return hashed


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_dropped and the kept text.

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased.  Keys
    of at least `least` code points that occur in at least `documents` different
    doc_ids lose all their lines, but for those in the largest such doc_id.  A
    null or empty text is one empty line.  A null doc_id doesn't count towards
    `documents` and never is the largest.  Rows that repeat id and text get
    equal results.  A text that loses all lines becomes empty.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    found = stored(rows.select("doc_id", "text_key", "text").mapInArrow(_hash_lines(least), _LINES), "lines")
    lines = found.select("doc_id", "text_key", F.explode("lines").alias("line")).select("doc_id", "text_key", "line.place", "line.line")
    frequent = lines.groupBy("line").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= documents)
    # As a table of its own, so that the join's shuffle of a very frequent line can be split.
    frequent = stored(frequent.select("line", "keeper"), "frequent-lines")
    dropped = (
        lines.join(frequent, "line")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.collect_set("place").alias("places"))
    )
    counted = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return counted.select("doc_id", (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), "text", "places").mapInArrow(_reassembled, _KEPT)


_KEPT = "doc_id long, n_lines long, n_dropped long, kept_text string"


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines joined again without those at the given places: one look at each line, however many are dropped."""
    for batch in batches:
        dropped, kept = [], []
        for text, places in zip(batch.column(2), batch.column(3), strict=True):
            text, places = text.as_py(), set(places.as_py() or ())
            dropped.append(len(places))
            kept.append("\n".join(line for place, line in enumerate(text.split("\n")) if place not in places) if places else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])
