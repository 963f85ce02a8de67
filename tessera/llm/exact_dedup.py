"""Exact deduplication with an extendible-hash index on shared files.

Every text has a 64-bit hash.  The index directory addresses buckets by leading
hash bits; a bucket whose texts outweigh its capacity is split, and the
directory doubles when a split needs one more bit.  It is planned from sums for
each prefix over all rows (at most 2**MOST_DEPTH numbers, however many rows
there are; a bucket of that depth is streamed, whatever it holds).  The index has
an entry for every text: hash, place in its chain, digest, size, the row that
stays and the group's size.

Only hashes that occur more than once can be copies.  A bounded bitmap of those
leaves the texts of the others where they are: their entries are written from
keys alone.  Map tasks fold their own copies of the rest first, so a text that
fills a third of the table travels once a task.  Each owner task has a range of
keys: it chains the texts of a hash, compares their bytes, and its part of the
index is a file in key order in the shared folder, from which verdicts are
joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import filter_bits, free_names, hash_filter, in_filter, maybe_in, new_path, stored, text_or_empty

MOST_DEPTH = 18
BUCKET_BYTES = 16 << 20
FOLD_BYTES = 16 << 20


def plan_directory(weights: dict[int, int], depth: int, capacity: int) -> np.ndarray:
    """The directory: bucket number for every value of the first g hash bits.

    `weights` has the bytes of each prefix of `depth` bits.  Starting from one
    bucket, overfull buckets split on their next bit; where a bucket already
    uses all directory bits the directory doubles first.  It stops at `depth`.
    """
    load = np.zeros(1 << depth, np.int64)
    for prefix, weight in weights.items():
        load[prefix] = weight
    load = np.concatenate([[0], np.cumsum(load)])
    directory, local, buckets = [0], [0], 1
    bits = 0
    todo = [(0, 0)]  # (bucket, its prefix)
    while todo:
        bucket, prefix = todo.pop()
        own = local[bucket]
        span = 1 << (depth - own)
        if own == depth or load[(prefix + 1) * span] - load[prefix * span] <= capacity:
            continue
        if own == bits:  # double
            directory = [x for x in directory for _ in range(2)]
            bits += 1
        local[bucket] = own + 1
        local.append(own + 1)
        half = 1 << (bits - own - 1)
        first = (prefix * 2 + 1) * half
        directory[first : first + half] = [buckets] * half
        todo += [(bucket, prefix * 2), (buckets, prefix * 2 + 1)]
        buckets += 1
    return np.array(directory, np.int64)


def _chain(chains: dict, key: int, text: bytes) -> list:
    """The entry of this text among those with its hash, by comparing bytes."""
    chain = chains.setdefault(key, [])
    for entry in chain:
        if entry[0] == text:
            return entry
    chain.append(entry := [text, None, 0])
    return entry


def _fold(entry: list, doc_id: int | None, n: int) -> None:
    if doc_id is not None:
        entry[1] = doc_id if entry[1] is None else max(entry[1], doc_id)
    entry[2] += n


_FOLDED = pa.schema([("h", pa.int64()), ("text", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])
_INDEX = pa.schema([("h", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_ENTRY = "h long, chain int, text_sha256 string, n_bytes long, keep_id long, group_size long"
#: Owner tasks divide the first so many bits of the keys among them.
RANGE_BITS = 24


def _owner(parts: int) -> Column:
    """The task that has this key: ranges of equal width, as hashes are spread evenly."""
    return (F.shiftrightunsigned("h", 64 - RANGE_BITS) * parts / (1 << RANGE_BITS)).cast("int")


def _addressed(directory):
    """Adds the bucket of each entry from the directory."""

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = directory.value
        bits = len(places).bit_length() - 1
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            slot = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places[slot]), *batch.columns], names=["bucket", *batch.schema.names])

    return address


def _folder(bitmap):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bitmap.value
        chains: dict[int, list] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(key, *entry) for key, chain in chains.items() for entry in chain]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOLDED)], schema=_FOLDED)

        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(in_filter(seen, keys)).tolist():
                text = batch.column(2)[k].as_buffer().to_pybytes()
                entry = _chain(chains, int(keys[k]), text)
                held += len(text) * (entry[2] == 0)
                _fold(entry, batch.column(0)[k].as_py(), 1)
                if held > FOLD_BYTES:
                    yield out()
                    chains, held = {}, 0
        if chains:
            yield out()

    return fold


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of h: one chain is held at a time."""
    at, chains, done = None, {}, []

    def close() -> None:
        if at is not None:
            for number, (text, keep, n) in enumerate(chains[at]):
                done.append((at, number, hashlib.sha256(text).hexdigest(), len(text), keep, n))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(_INDEX)], schema=_INDEX)

    for batch in batches:
        keys, keeps, sizes = (batch.column(k).to_pylist() for k in (0, 2, 3))
        for h, text, keep, n in zip(keys, batch.column(1), keeps, sizes, strict=True):
            if at != h:
                close()
                at, chains = h, {}
            _fold(_chain(chains, h, text.as_buffer().to_pybytes()), keep, n)
        if len(done) >= 4096:
            yield out()
            done.clear()
    close()
    yield out()


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty ones, and empty texts are copies of each other.
    A null doc_id counts towards its group's size but never wins while the
    group has another id; in a group of null ids only, all stay.  Rows that
    repeat both id and text get the same verdict.  Columns other than `doc_id`
    and `text` are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    keys = stored(rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes")), "exact-keys")

    copied = stored(keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "exact-copied")
    total = keys.agg(F.sum(F.col("n_bytes") + 1).alias("bytes")).first()["bytes"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    capacity = min(capacity, max(1, total // (8 * parts)))
    depth = min(MOST_DEPTH, (total // capacity).bit_length() + 2)
    prefix = F.shiftrightunsigned("h", 64 - depth)
    weights = {r[0]: r[1] for r in keys.groupBy(prefix.alias("prefix")).agg(F.sum(F.col("n_bytes") + 1).cast("long")).collect()}
    directory = spark.sparkContext.broadcast(plan_directory(weights, depth, capacity))

    bitmap = hash_filter(copied, "h", filter_bits(copied.count()))
    alone = maybe_in(keys, "h", bitmap, wanted=False)
    entries = alone.select("h", F.lit(0).alias("chain"), "text_sha256", F.col("n_bytes").cast("long").alias("n_bytes"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    folded = rows.select("doc_id", "h", F.col("text").cast("binary").alias("text")).mapInArrow(_folder(spark.sparkContext.broadcast(bitmap)), "h long, text binary, keep_id long, n long")
    chained = folded.repartitionById(parts, _owner(parts)).sortWithinPartitions("h").mapInArrow(_own, _ENTRY)
    index = chained.unionByName(entries).repartitionById(parts, _owner(parts)).mapInArrow(_addressed(directory), f"bucket long, {_ENTRY}").sortWithinPartitions("bucket", "h", "chain")
    path = new_path(spark, "exact-index")
    index.write.parquet(path)
    # What stands alone needs no look at the index.
    index = spark.read.schema(index.schema).parquet(path).where("group_size > 1").select("h", "text_sha256", "keep_id", "group_size")

    joined = keys.join(index, ["h", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns; of each group the largest id.

    Rows are matched by id and text hash, so a repeated id with two texts is safe.
    """
    kept = exact_groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    own_id, own_sha, kept_id, kept_sha = free_names(docs, "own_id", "own_sha", "kept_id", "kept_sha")
    rows = docs.withColumns({own_id: F.col(doc_id).cast("long"), own_sha: F.sha2(text_or_empty(text), 256)})
    kept = kept.toDF(kept_id, kept_sha)
    return rows.join(kept, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_sha) == F.col(kept_sha)), "left_semi").drop(own_id, own_sha)
