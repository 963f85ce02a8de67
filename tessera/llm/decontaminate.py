"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of `window` words, and a window is a set of
positioned word shingles.  A document contains a window only if it contains
every shingle of it, so with containment 1 the prefix that the join needs is one
shingle, and the rarest in the corpus makes the fewest candidates:

1. shingles of all windows are counted over all documents (a bounded bitmap
   keeps other shingles at home, each task adds up its own);
2. each window keeps its rarest shingle and the shingle's offset;
3. documents send only the positions of shingles that are in some prefix, with
   the words around, and are joined with the windows on the shingle;
4. length and position bounds and an exact comparison of the window's words
   decide.

Both sides are shuffled on the shingle unless Spark measures one to be small, so
the benchmark may be of any size and frequent shingles can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.shared import filter_bits, free_names, hash_filter, in_filter, stored

#: ASCII digits and letters, and every non-ASCII byte, are parts of words.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

SHINGLE = 3

_WINDOWS = pa.schema([("item_id", pa.int64()), ("words", pa.string()), ("n_window", pa.int32()), ("offset", pa.int32()), ("shingle", pa.int64())])
_COUNTS = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])
_HIT = pa.struct([("shingle", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("words", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(_HIT))])


def _words(block: tb.Block):
    block.data = tb.LOWER[block.data]
    starts, ends, doc = tb.spans(block, WORD)
    return starts, ends, doc, tb.span_hashes(block.data, starts, ends)


def _shingles(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first words of all shingles within documents, and the shingles."""
    found = tb.sequence_hashes(hashes, width)
    if not len(found):
        return np.zeros(0, np.int64), found
    places = np.flatnonzero(doc[: len(found)] == doc[width - 1 :])
    return places, found[places]


def _cut_windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            ids = block.batch.column(0).to_pylist()
            starts, ends, doc, hashes = _words(block)
            first = tb.run_starts(doc, len(block))
            rows = []
            for k in range(len(block)):
                a, b = first[k], first[k + 1]
                length = min(window, b - a)
                width = min(SHINGLE, length)
                own = tb.sequence_hashes(hashes[a:b], width).view(np.int64) if length else ()
                words = [block.data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
                for at in range(b - a - length + 1 if length else 0):
                    joined = " ".join(words[at : at + length])
                    rows += [(ids[k], joined, length, o, int(own[at + o])) for o in range(length - width + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_WINDOWS)], schema=_WINDOWS)

    return cut


def _count(bitmap, widths: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bitmap.value
        parts: list[np.ndarray] = []
        for block in tb.blocks(batches):
            _, _, doc, hashes = _words(block)
            for width in widths:
                _, found = _shingles(hashes, doc, width)
                parts.append(found[in_filter(seen, found)])
            if sum(map(len, parts)) > 1 << 20:
                yield _counted(parts)
                parts = []
        yield _counted(parts)

    return count


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], schema=_COUNTS)


def _find(bitmap, widths: list[int], window: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bitmap.value
        for block in tb.blocks(batches, "text"):
            starts, ends, doc, hashes = _words(block)
            first = tb.run_starts(doc, len(block))
            hits: list[list[dict]] = [[] for _ in range(len(block))]
            for width in widths:
                places, found = _shingles(hashes, doc, width)
                chosen = np.flatnonzero(in_filter(seen, found))
                for at, key in zip(places[chosen].tolist(), found[chosen].view(np.int64).tolist(), strict=True):
                    k = int(doc[at])
                    low, high = max(int(first[k]), at - window + width), min(int(first[k + 1]), at + window)
                    around = b" ".join(block.data[s:e].tobytes() for s, e in zip(starts[low:high], ends[low:high], strict=True))
                    hits[k].append({"shingle": key, "place": at - int(first[k]), "first": low - int(first[k]), "words": around.decode()})
            yield pa.RecordBatch.from_arrays([block.batch.column(0), block.batch.column(1), pa.array(np.diff(first)), pa.array(hits, _FOUND.field(3).type)], schema=_FOUND)

    return find


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What contamination() sums up, as three tables.

    Documents (doc_id, text_key, n_words); verified occurrences (doc_id,
    text_key, start, n_window, words) with start counted in words; and the
    items of each window (item_id, words).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    shingles = stored(items.mapInArrow(_cut_windows(window), "item_id long, words string, n_window int, offset int, shingle long"), "bench-shingles")
    windows = shingles.select("words", "n_window", "offset", "shingle").distinct()
    # Narrow shingles occur only in items of fewer words than a shingle has.
    widths = sorted({min(SHINGLE, r[0]) for r in shingles.select(F.least("n_window", F.lit(SHINGLE))).distinct().collect()})
    bits = filter_bits(shingles.select("shingle").distinct().count())

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    everything = spark.sparkContext.broadcast(hash_filter(shingles, "shingle", bits))
    counts = rows.select("text").mapInArrow(_count(everything, widths), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = (
        windows.join(counts, "shingle", "left")
        .groupBy("words", "n_window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"))
        .where("rarest.n > 0")
        .select("words", "n_window", "rarest.shingle", "rarest.offset")
    )
    rarest = stored(rarest, "bench-prefixes")
    prefixes = spark.sparkContext.broadcast(hash_filter(rarest, "shingle", bits))
    found = stored(rows.mapInArrow(_find(prefixes, widths, window), "doc_id long, text_key long, n_words long, hits array<struct<shingle:long,place:int,first:int,words:string>>"), "bench-candidates")

    candidates = found.select("doc_id", "text_key", "n_words", F.explode("hits").alias("hit")).select("doc_id", "text_key", "n_words", "hit.shingle", "hit.place", "hit.first", F.split("hit.words", " ").alias("around"))
    start = F.col("place") - F.col("offset")
    occurrences = (
        candidates.join(rarest, "shingle")
        .withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + F.col("n_window") <= F.col("n_words")))
        .where(F.array_join(F.slice("around", F.col("start") - F.col("first") + 1, F.col("n_window")), " ") == F.col("words"))
        .select("doc_id", "text_key", "start", "n_window", "words")
        .distinct()
    )
    return found.select("doc_id", "text_key", "n_words"), occurrences, shingles.select("item_id", "words").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **columns: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII
    characters.  A null or empty text has no words and is clean; an item without
    words matches nothing; an item of fewer than `window` words is one window.
    Equal windows of several items count for each of them, rows that repeat id
    and text get equal results, null item ids are left out of n_items and of the
    digest.  Only the id and text columns are read.
    """
    every, occurrences, items = matches(docs, benchmark, window, **columns)
    keys = ["doc_id", "text_key"]
    order = Window.partitionBy(*keys).orderBy("start")
    end = F.col("start") + F.col("n_window")
    covered = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = occurrences.groupBy(*keys, "start").agg(F.max("n_window").alias("n_window"))
    hit = places.select(*keys, F.greatest(F.lit(0), end - F.greatest(F.col("start"), covered)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n_hit"))
    named = (
        occurrences.select(*keys, "words").distinct().join(items, "words").groupBy(*keys)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = hit.alias("h").join(named.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h.text_key = i.text_key")).select("h.*", "i.items")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_hit", "items")
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, all columns."""
    _, occurrences, _ = matches(docs, benchmark, window, doc_id, text)
    own_id, own_key, bad_id, bad_key = free_names(docs, "own_id", "own_key", "bad_id", "bad_key")
    bad = occurrences.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    rows = docs.withColumns({own_id: F.col(doc_id).cast("long"), own_key: F.xxhash64(F.col(text).cast("string"))})
    return rows.join(bad, F.col(own_id).eqNullSafe(F.col(bad_id)) & (F.col(own_key) == F.col(bad_key)), "left_anti").drop(own_id, own_key)
