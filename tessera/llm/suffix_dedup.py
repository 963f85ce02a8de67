"""Removal of long repeated substrings by blockwise, difference-cover suffix sorting.

Every byte covered by a string of `length` bytes that also starts elsewhere is
removed.  The suffixes of the corpus, bounded to `length` bytes, fall into
buckets that are sorted one at a time:

1. A suffix's bucket is its anchor, the leftmost least of the hashes of the
   GRAM-byte strings inside it.  Equal suffixes have the same anchor at the same
   offset, and neighbouring suffixes mostly share theirs, so one row stands for
   the run of suffixes [low, high] of an anchor.  Rows of an anchor that occurs
   once are dropped after one shuffle; that is nearly all text.
2. Two runs whose whole extent (all bytes of all their suffixes) is equal settle
   each other.  What is left are the ends of repeats.
3. Extents of the open buckets, one for each class of equal ones, are shuffled
   on the anchor and sorted bucket after bucket.  Positions at a difference
   cover modulo PERIOD are ranked once by their next RANKED bytes; a suffix is
   then ordered by its first few bytes up to a cover position, the ranks there
   and at the last cover position that still fits, and its last few bytes, so
   long ties cost two comparisons of ranks.  Neighbours that tie are compared
   byte by byte.
4. A bucket of more than MOST runs is split before it is sorted: by how far its
   suffixes start before the anchor, in steps of a width, and by the bytes that
   all suffixes of such a step share.  Equal suffixes stay together; parts that
   are equal as a whole settle each other, and one of them goes on.  What is
   still too large is split by a smaller width, down to single suffixes.

Texts themselves are shuffled only where something is open or to be cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.shared import filter_bits, hash_filter, maybe_in, stored

GRAM = 128
#: A perfect difference set modulo 57: every difference occurs once.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
#: No position is further than this from the next one of the cover.
GAP = 19
MOST = 4096
#: The widths by which large buckets are split, one after another.
STEPS = (64, 16, 4, 1)
#: Bits of a place within the bytes that are looked at at once; the same everywhere, so that equal bytes get equal anchors.
PLACE_BITS = 22
#: Suffixes sorted at once.
BATCH = 200_000
#: Bytes of different parts that a task remembers.
HELD_BYTES = 8 << 20
#: Rows of an anchor that a task holds.
HELD_ROWS = 1 << 16


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each run of suffixes that share an anchor: document, anchor place, first and last suffix, anchor hash, hash of the extent."""
    gram = min(GRAM, length // 2)
    n = len(data)
    up, down = tb.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tb.BYTE_VALUES[data] * up[:n], out=total[1:])
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if b - a >= length] or [np.zeros(0, np.int64)])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = tb.mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    bits = np.uint64(PLACE_BITS)
    keys = (hashes >> bits) << bits | np.arange(len(hashes), dtype=np.uint64)
    span, have = length - gram + 1, 1  # least of `span` neighbours, by doubling
    while have * 2 <= span:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    if have < span:
        keys = np.minimum(keys[: len(keys) - (span - have)], keys[span - have :])
    place = (keys[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    heads = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    low, high = starts[heads], starts[np.concatenate([heads[1:], [len(starts)]]) - 1]
    place, doc = place[heads], doc[heads]
    extent = tb.mix64((total[high + length] - total[low]) * down[low])
    extent = tb.mix64(extent ^ ((place - low).astype(np.uint64) << np.uint64(32)) ^ (high - low).astype(np.uint64))
    return doc, place - offsets[doc], low - offsets[doc], high - offsets[doc], hashes[place], extent


#: What a row is in its bucket: equal to another and not the first of those, the first of equal ones, or like no other.
REPEATED, FIRST, LONE = 0, 1, 2
_RUN = "anchor long, extent long, doc_id long, text_key long, place int, low int, high int, kind byte"


def _pieces(block: tb.Block, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes and offsets of a block, or a long document in pieces that share no suffix; and the bytes before."""
    n = len(block.data)
    if n <= 2 * tb.PIECE or len(block) > 1:
        yield block.data, block.offsets, 0
        return
    for at in range(0, n - length + 1, tb.PIECE):
        own = block.data[at : at + tb.PIECE + length - 1]
        yield own, np.array([0, len(own)]), at


def _equal_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether runs a[k] and b[k], alike by their hashes, have the same bytes."""
    raw = memoryview(np.ascontiguousarray(data))
    starts, ends = starts.tolist(), ends.tolist()
    return np.fromiter((raw[starts[x] : ends[x]] == raw[starts[y] : ends[y]] for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))


def _runs(length: int):
    """The runs of all documents; of equal ones within a piece only the first need go on, and neighbours of the others are one row."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            for data, offsets, at in _pieces(block, length):
                doc, place, low, high, anchor, extent = anchor_runs(data, offsets, length)
                order = np.lexsort((extent, anchor))
                same = (anchor[order][1:] == anchor[order][:-1]) & (extent[order][1:] == extent[order][:-1])
                alike = np.flatnonzero(same)
                first = offsets[doc]
                # Hashes propose, bytes decide.
                same[alike] = _equal_runs(data, first + low, first + high + length, order[alike], order[alike + 1])
                before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
                kind = np.empty(len(order), np.int8)
                if len(order):
                    kind[order] = np.where(before, REPEATED, np.where(after, FIRST, LONE))
                joined = np.zeros(len(order), bool)
                joined[1:] = (kind[1:] == REPEATED) & (kind[:-1] == REPEATED) & (doc[1:] == doc[:-1]) & (low[1:] == high[:-1] + 1)
                heads = np.flatnonzero(~joined)
                high = high[np.concatenate([heads[1:], [len(joined)]]) - 1] if len(heads) else high
                owner = pa.array(doc[heads])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[heads].view(np.int64)), pa.array(extent[heads].view(np.int64)), block.batch.column(0).take(owner), block.batch.column(1).take(owner), *(pa.array((x + at).astype(np.int32)) for x in (place[heads], low[heads], high)), pa.array(kind[heads])],
                    names=["anchor", "extent", "doc_id", "text_key", "place", "low", "high", "kind"],
                )

    return runs


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of (anchor, extent); those that are alone under their anchor are dropped.

    A row's kind follows from its neighbours.  Wanted in sorting are the classes
    of an anchor that has several, a LONE one among them.  Rows of an anchor are
    held until it ends; of more than HELD_ROWS all classes are wanted, which
    only costs work.
    """
    held: pa.RecordBatch | None = None
    before: tuple[int, int] | None = None

    def judge(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch | None:
        nonlocal held, before
        n = batch.num_rows
        anchor, extent = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        m = n if last else int(np.searchsorted(anchor, anchor[-1]))
        cut = n - m > HELD_ROWS
        if cut:
            m = n - 1
        held = batch.slice(m)
        if m == 0:
            return None
        same_anchor = np.zeros(n + 1, bool)
        same_all = np.zeros(n + 1, bool)
        same_anchor[1:n] = anchor[1:] == anchor[:-1]
        same_all[1:n] = same_anchor[1:n] & (extent[1:] == extent[:-1])
        if before is not None:
            same_anchor[0] = anchor[0] == before[0]
            same_all[0] = same_anchor[0] and extent[0] == before[1]
        before = (int(anchor[m - 1]), int(extent[m - 1]))
        known = batch.column(7).to_numpy()[:m] == FIRST
        kind = np.where(same_all[:m], REPEATED, np.where(same_all[1 : m + 1] | known, FIRST, LONE))
        keep = same_anchor[:m] | same_anchor[1 : m + 1] | known
        of = np.cumsum(~same_anchor[:m])  # 0: the anchor that was cut
        wanted = (np.bincount(of, kind > REPEATED) > 1) & (np.bincount(of, kind == LONE) > 0)
        wanted[0] = True
        wanted[-1] |= cut
        if not keep.any():
            return None
        wanted = wanted[of] & (kind > REPEATED)
        return pa.RecordBatch.from_arrays([*batch.slice(0, m).columns[:7], pa.array(kind.astype(np.int8)), pa.array(wanted)], names=[*batch.schema.names, "wanted"]).filter(pa.array(keep))

    for batch in batches:
        if batch.num_rows:
            joined = batch if held is None or not held.num_rows else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if (out := judge(joined, False)) is not None:
                yield out
    if held is not None and held.num_rows and (out := judge(held, True)) is not None:
        yield out


def _extents(length: int):
    """The bytes of each wanted run of a document."""

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc_id", "text_key", "place", "low", "high", "lone", "bytes"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, key, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                    data = text.as_buffer().to_pybytes()
                    rows += [(r["anchor"], doc_id, key, r["place"], r["low"], r["high"], r["lone"], data[r["low"] : r["high"] + length]) for r in runs]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return extents


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as an integer; data must have 7 bytes to spare."""
    n = len(data) - 7
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _few_bytes(words: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of data[place:place + size] for sizes below 24."""
    out = np.zeros(len(places), np.uint64)
    for k in range(0, 24, 8):
        own = words[np.minimum(places + k, len(words) - 1)] & _MASKS[np.clip(sizes - k, 0, 8)]
        out = tb.mix64(out ^ own)
    return out


def repeated_suffixes(bucket: np.ndarray, before: np.ndarray, data: np.ndarray, extents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of several buckets; which (member, suffix) have an equal one.

    Member k has the bytes data[extents[k]:extents[k + 1]], of which a suffix
    starts at every place where `length` bytes fit, and its anchor `before[k]`
    bytes after its start.
    """
    ranked = length - 2 * GAP
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    words = _words(padded)
    sizes = np.diff(extents)
    # Ranks at cover positions; positions count from the anchor, so equal suffixes meet the cover alike.
    owner, within = tb.ragged(np.maximum(sizes - ranked + 1, 0))
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    sampled = np.flatnonzero(in_cover[(within - before[owner]) % PERIOD])
    places = extents[owner[sampled]] + within[sampled]
    rows = np.lib.stride_tricks.sliding_window_view(data, ranked)[places]
    _, rank = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, ranked))).ravel(), return_inverse=True)
    rank_at = np.full(len(data), -1, np.int64)
    rank_at[places] = rank
    # Steps to the next cover position and from the last one before.
    ahead = np.array([next(s for s in range(PERIOD) if in_cover[(p + s) % PERIOD]) for p in range(PERIOD)])
    behind = np.array([next(s for s in range(PERIOD) if in_cover[(p - s) % PERIOD]) for p in range(PERIOD)])

    member, within = tb.ragged(sizes - length + 1)
    start = extents[member] + within
    phase = (within - before[member]) % PERIOD
    lead = ahead[phase]
    slack = length - ranked
    tail = behind[(phase + slack) % PERIOD]
    ranks = rank_at[start + lead] * (len(rank) + 1) + rank_at[start + slack - tail]
    ends = _few_bytes(words, start, lead) ^ tb.mix64(_few_bytes(words, start + length - tail, tail))
    where = bucket[member] * np.int64(1 << 20) + (before[member] - within + (1 << 19))
    order = np.lexsort((ends, ranks, where))
    a, b = order[:-1], order[1:]
    tie = np.flatnonzero((where[a] == where[b]) & (ranks[a] == ranks[b]) & (ends[a] == ends[b]))
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    found = np.zeros(len(order), bool)
    for at in range(0, len(tie), 1 << 15):
        part = tie[at : at + (1 << 15)]
        equal = (view[start[a[part]]] == view[start[b[part]]]).all(1)
        found[a[part[equal]]] = True
        found[b[part[equal]]] = True
    return member[found], within[found]


_MARKS = "doc_id long, text_key long, low int, high int"


def _mark_batch(doc_ids: list, keys: np.ndarray, low: np.ndarray, member: np.ndarray, within: np.ndarray) -> pa.RecordBatch:
    """Neighbouring suffixes of a member as one interval."""
    order = np.lexsort((within, member))
    member, within = member[order], within[order]
    heads = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (within[1:] != within[:-1] + 1)])) if len(member) else np.zeros(0, np.int64)
    last = np.concatenate([heads[1:], [len(member)]])[: len(heads)] - 1
    own = member[heads]
    return pa.RecordBatch.from_arrays(
        [pa.array([doc_ids[k] for k in own.tolist()], pa.int64()), pa.array(keys[own], pa.int64()), pa.array((low[own] + within[heads]).astype(np.int32)), pa.array((low[own] + within[last]).astype(np.int32))],
        names=["doc_id", "text_key", "low", "high"],
    )


def _sort_buckets(length: int):
    """Rows come in anchor order; whole buckets are gathered up to BATCH suffixes and sorted."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out(part: list[tuple]) -> Iterator[pa.RecordBatch]:
            _, bucket = np.unique(np.array([r[0] for r in part], np.int64), return_inverse=True)
            place, low = (np.array([r[k] for r in part], np.int64) for k in (3, 4))
            lone = np.array([r[6] for r in part])
            extents = np.concatenate([[0], np.cumsum([len(r[7]) for r in part])])
            member, within = repeated_suffixes(bucket, place - low, np.frombuffer(b"".join(r[7] for r in part), np.uint8), extents, length)
            chosen = lone[member]
            yield _mark_batch([r[1] for r in part], np.array([r[2] for r in part], np.int64), low, member[chosen], within[chosen])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if held >= BATCH and row[0] != rows[-1][0]:
                    yield from out(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[7]) - length + 1
        if rows:
            yield from out(rows)

    return sort


_PART = "anchor long, extent long, doc_id long, text_key long, place int, low int, high int, lone boolean, bytes binary"


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split(" ")[0] for f in _PART.split(", ")])


def _digest(*parts: bytes | int) -> int:
    out = hashlib.blake2b(digest_size=8)
    for part in parts:
        out.update(part if isinstance(part, bytes) else int(part).to_bytes(8, "little", signed=True))
    return int.from_bytes(out.digest(), "little", signed=True)


def _split(length: int, width: int):
    """Runs of large buckets in parts: their new bucket is the old one, the step, and the bytes that the step's suffixes share.

    Of equal parts a task sends two on; further ones are marks (without bytes).
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        held = 0
        for batch in batches:
            rows = []
            for anchor, doc_id, key, place, low, high, lone, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for step in range((place - high) // width, (place - low) // width + 1):
                    a, b = max(low, place - step * width - width + 1), min(high, place - step * width)
                    own = data[a - low : b - low + length]
                    common = place - step * width - low
                    bucket = _digest(anchor, step, data[common : common + length - width + 1])
                    extent = _digest(place - a, b - a, own)
                    known = seen.setdefault((bucket, extent), [own, 0])
                    known[1] += 1
                    held += len(own) * (known[1] == 1)
                    again = known[1] > 2 and known[0] == own
                    rows.append((bucket, extent, doc_id, key, place, a, b, lone, None if again else own))
                if held > HELD_BYTES:
                    seen, held = {}, 0
            yield _part_batch(rows)

    return split


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of (anchor, extent): of equal parts one goes on as settled, the others are marks."""
    at, first = None, None
    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] == at and row[8] == first[8]:
                if first[7] is not None:  # the first of equal ones is a mark too, and needs no other any more
                    rows += [(*first[:8], None)] if first[7] else []
                    first = (*first[:7], None, first[8])
                rows.append((*row[:8], None))
                continue
            if first is not None:
                rows.append((*first[:7], bool(first[7]), first[8]))
            at, first = row[:2], row
        yield _part_batch(rows)
    if first is not None:
        yield _part_batch([(*first[:7], bool(first[7]), first[8])])


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, removed, spans, kept = [], [], [], []
                for text, marks in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    data = text.as_buffer().to_pybytes()
                    pieces, last, gone, n = [], 0, 0, 0
                    end = 0  # of the bytes removed so far
                    for m in sorted(marks or (), key=lambda m: m["low"]):
                        if m["low"] > end or n == 0:
                            pieces.append(data[last if n else 0 : m["low"]])
                            n += 1
                            gone += m["high"] + length - m["low"]
                        elif m["high"] + length > end:
                            gone += m["high"] + length - end
                        end = max(end, m["high"] + length)
                        last = end
                    pieces.append(data[last:])
                    sizes.append(len(data))
                    removed.append(gone)
                    spans.append(n)
                    kept.append(b"".join(pieces))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans and `kept`, the bytes that stay.

    Strings are compared as UTF-8 bytes within documents, so `kept` may cut a
    character.  A null text is empty; texts shorter than `length` lose nothing;
    of a repeated row both occurrences are removed.  `length` must be 64 at
    least.  A null doc_id is a document like any other.
    """
    if length < 64:
        raise ValueError("length must be 64 at least")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    runs = stored(rows.mapInArrow(_runs(length), _RUN), "runs")
    open_runs = runs.where(f"kind > {REPEATED}").repartition(parts, "anchor").sortWithinPartitions("anchor", "extent")
    kinds = stored(open_runs.mapInArrow(_classify, f"{_RUN}, wanted boolean"), "classified")
    ends = ["doc_id", "text_key", "low", "high"]
    settled = runs.where(f"kind = {REPEATED}").select(*ends).unionByName(kinds.where(f"kind < {LONE}").select(*ends))

    wanted = kinds.where("wanted").select("anchor", "doc_id", "text_key", "place", "low", "high", (F.col("kind") == LONE).alias("lone"))
    of_doc = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("anchor", "place", "low", "high", "lone")).alias("runs"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    # Only texts that may have an open run are shuffled.
    of_open = maybe_in(rows, "text_key", hash_filter(wanted, "text_key", filter_bits(wanted.count())))
    extents = of_open.join(of_doc, same).select("doc_id", "text_key", "text", "runs").mapInArrow(_extents(length), "anchor long, doc_id long, text_key long, place int, low int, high int, lone boolean, bytes binary")
    large = stored(wanted.groupBy("anchor").count().where(F.col("count") > most).select("anchor"), "large-buckets")
    more = []
    for width in STEPS:
        if large.isEmpty():
            break
        extents = stored(extents, "extents")
        parts_of = stored(extents.join(large, "anchor", "left_semi").mapInArrow(_split(length, min(width, length // 2)), _PART), "bucket-parts")
        ordered = parts_of.where("bytes IS NOT NULL").repartition(parts, "anchor", "extent").sortWithinPartitions("anchor", "extent")
        settled_parts = stored(ordered.mapInArrow(_settle, _PART), "settled-parts")
        for marked in (parts_of, settled_parts):
            more.append(marked.where("bytes IS NULL AND lone").select("doc_id", "text_key", "low", "high"))
        open_parts = settled_parts.where("bytes IS NOT NULL").drop("extent")
        extents = extents.join(large, "anchor", "left_anti").unionByName(open_parts)
        large = stored(open_parts.groupBy("anchor").count().where(F.col("count") > most).select("anchor"), "large-buckets")
    marks = extents.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sort_buckets(length), _MARKS)
    for part in more:
        marks = marks.unionByName(part)
    marks = stored(marks.unionByName(settled), "marks")
    marked = hash_filter(marks, "text_key", filter_bits(marks.select("doc_id", "text_key").distinct().count()))
    of_doc = marks.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("low", "high")).alias("marks"))
    touched = maybe_in(rows, "text_key", marked).join(of_doc, same, "left").select("doc_id", "text", "marks")
    whole = maybe_in(rows, "text_key", marked, wanted=False)
    n = F.length("text").cast("long")
    zero = F.lit(0).cast("long")
    whole = whole.select("doc_id", n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    return touched.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(whole)
