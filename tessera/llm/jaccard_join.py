"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two sets with Jaccard similarity of t or more share at least ceil(t * n) of the
n items of either.  With items in a global order, rarest first, both therefore
share at least l items of their first n - ceil(t * n) + l, for every l: the
l-prefix.  A document whose short prefix would meet many others takes a longer
one and in turn demands more shared items of it, so a pair must share as many
prefix items as the smaller l of its two documents before it is verified.

1. Every document's distinct word shingles are hashed (64 bits); a fixed-size
   sketch counts in how many documents each occurs, and a 128-bit hash of the
   whole set finds equal sets, of which one represents all.
2. Prefix items are shuffled once on the item; items of one document only end
   there.
3. Links are found in rounds.  In the first ones each document is verified with
   one partner per round only, the pivot it shares most prefix items with, which
   joins large groups of near copies at a cost in proportion to their size.  An
   item's pivot is the document in which fewest items come before it, so the one
   with least of its own, and in the second round any.  Then documents on items
   that many components hold try partners of one such item, twice as many in
   every round, until a round links nothing: a large group takes in its
   stragglers after a number of tries that depends on how many of its documents
   they are similar to, not on its size.  The
   last round takes every remaining pair across the components found so far.
   Pairs meet there on the shortest prefixes that their two sizes call for, so
   that documents that have drifted apart mostly don't; then all shared items of
   the whole prefixes are counted against both levels.
   Components are all that is asked for, so pairs within one are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.components import merged_components
from tessera.llm.shared import filter_bits, free_names, hash_filter, in_filter, stored

#: Words are runs of anything but space and the ASCII controls from tab to carriage return.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False

#: Small blocks: a task's temporaries stay at a few megabytes.
BLOCK = 1 << 18
SKETCH_BITS = 20
PART = 4096
MOST_LEVEL = 4
#: Pivot rounds for all prefix items; then the partners tried in each further round, for items in more than CROWD components.
PIVOT_ROUNDS, TRIES, CROWD = 2, (8, 16, 32, 64), 32


def shingle_sets(block: tb.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the block's documents, one after another, and their numbers.

    A document of fewer words than `width`, but not none, has its whole sequence as one shingle.
    """
    block.data = tb.LOWER[block.data]
    starts, ends, doc = tb.spans(block, WORD)
    words = tb.span_hashes(block.data, starts, ends)
    first = tb.run_starts(doc, len(block))
    n_words = np.diff(first)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    items = np.empty(offsets[-1], np.uint64)
    full = tb.sequence_hashes(words, width)
    own = doc[: len(full)] == doc[width - 1 :] if len(full) else np.zeros(0, bool)
    items[np.repeat(n_words >= width, counts)] = full[own]
    for n in range(1, width):
        for k in np.flatnonzero(n_words == n).tolist():
            items[offsets[k]] = tb.sequence_hashes(words[first[k] : first[k + 1]], n)[0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        items[a:b].sort()
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    new[offsets[:-1][counts > 0]] = True
    owner = np.repeat(np.arange(len(block)), counts)
    return items[new], np.bincount(owner[new], minlength=len(block))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_SCANNED = "doc_id long, n int, h1 long, h2 long, part int, counts binary"


def _scan(width: int):
    """Set sizes and hashes of all documents, and at the end the task's sketch in parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        held: list[np.ndarray] = []
        for block in tb.blocks(batches, limit=BLOCK):
            items, counts = shingle_sets(block, width)
            held.append((items >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
            if sum(map(len, held)) > len(sketch):
                sketch += np.bincount(np.concatenate(held), minlength=len(sketch))
                held.clear()
            n = len(block)
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column(0),
                    pa.array(counts.astype(np.int32)),
                    pa.array(_sums(items, counts).view(np.int64)),
                    pa.array(_sums(tb.mix64(items), counts).view(np.int64)),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names=["doc_id", "n", "h1", "h2", "part", "counts"],
            )
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=len(sketch))
        parts = [(k, p.astype("<u4").tobytes()) for k, p in enumerate(np.minimum(sketch, 2**32 - 1).reshape(-1, PART)) if p.any()]
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
            names=["doc_id", "n", "h1", "h2", "part", "counts"],
        )

    return scan


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition's sketch parts: as many arrays are held as it has parts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
            total[part] = total[part] + own if part in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


#: `place` counts the document's items that come before in the global order.
_PREFIX = "item long, node long, n int, level byte, place int"


def _prefixes(sketch, width: int, percent: int):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = sketch.value
        usual = int(np.median(counts_of))
        seen: set[tuple[int, int]] = set()
        for block in tb.blocks(batches, limit=BLOCK):
            ids = block.batch.column(0).to_numpy(zero_copy_only=False)
            items, counts = shingle_sets(block, width)
            known = np.minimum(counts_of[(items >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (1 << 20) - 1).astype(np.uint64)
            order = (known << np.uint64(44)) | (items >> np.uint64(20))
            h1, h2 = _sums(items, counts).tolist(), _sums(tb.mix64(items), counts).tolist()
            offsets = np.concatenate([[0], np.cumsum(counts)]).tolist()
            chosen, owners, levels, places = [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if a == b or (h1[k], h2[k]) in seen:
                    continue
                seen.add((h1[k], h2[k]))  # further copies in this task add nothing
                n = b - a
                share = -(-percent * n // 100)  # the least number of shared items
                own = order[a:b]
                most = min(n, n - share + min(MOST_LEVEL, share))
                ranked = np.sort(own)[:most]
                level = _level(ranked[: n - share + 1], usual, share)
                # A tie at the end only lengthens the prefix.
                taken = a + np.flatnonzero(own <= ranked[n - share + level - 1])
                chosen.append(taken)
                places.append(np.searchsorted(ranked, order[taken]))
                owners.append(np.full(len(taken), k))
                levels.append(np.full(len(taken), level, np.int8))
            if not chosen:
                continue
            chosen, owners = np.concatenate(chosen), np.concatenate(owners)
            yield pa.RecordBatch.from_arrays([pa.array(items[chosen].view(np.int64)), pa.array(ids[owners], pa.int64()), pa.array(counts[owners].astype(np.int32)), pa.array(np.concatenate(levels)), pa.array(np.concatenate(places).astype(np.int32))], names=["item", "node", "n", "level", "place"])

    return prefixes


def _level(ranked: np.ndarray, usual: int, share: int) -> int:
    """How many prefix items to demand: one more for each factor of four in the expected partners per prefix item."""
    counts = (ranked >> np.uint64(44)).astype(np.int64)
    partners = np.maximum(counts - 2 * usual - 4, 0).sum() / len(ranked)
    level = 1
    while partners > 1 and level < min(MOST_LEVEL, share):
        partners /= 4
        level += 1
    return level


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in item order, those whose item stands in more than one row; one row is carried over."""
    last, last_kept = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        items = batch.column(0).to_numpy()
        same = items[1:] == items[:-1]
        keep = np.zeros(len(items), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None:
            keep[0] |= last_kept
        last, last_kept = batch.slice(len(items) - 1), bool(keep[-1])
        if keep[:-1].any():
            yield batch.slice(0, len(items) - 1).filter(pa.array(keep[:-1]))
    if last is not None and last_kept:
        yield last


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of (item, rank): each is paired with the first of its item, if in another component."""
    at, pivot = None, None
    for batch in batches:
        items, *rest = (batch.column(k).to_numpy() for k in range(5))
        if not len(items):
            continue
        heads = np.ones(len(items), bool)
        heads[1:] = items[1:] != items[:-1]
        heads[0] = at is None or items[0] != at
        first = np.maximum.accumulate(np.where(heads, np.arange(len(items)), -1))
        own = [np.where(first >= 0, values[first], values[0] if pivot is None else pivot[k]) for k, values in enumerate(rest)]
        at, pivot = items[-1], [values[-1] for values in own]
        other = np.flatnonzero(own[1] != rest[1])
        if len(other):
            columns = [own[0], rest[0], own[2], rest[2], own[3], rest[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c[other]) for c in columns], names=["a", "b", "an", "bn", "al", "bl"])


def _possible(percent: int) -> Column:
    """Whether a pair that shares `met` prefix items can be similar.

    Sizes must be close enough.  Shared items that are not in both prefixes come
    after the end of one of them, and a prefix of level l leaves
    ceil(t * n) - l items, so `met` and the larger rest bound the intersection.
    """
    share = [F.ceil(percent * F.col(n) / 100) - F.col(level) for n, level in (("an", "al"), ("bn", "bl"))]
    needed = F.ceil(percent * (F.col("an") + F.col("bn")) / (100 + percent))
    close = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    return close & (F.col("met") >= F.least("al", "bl")) & (F.col("met") >= needed - F.greatest(*share))


def _in_prefix(place: str, size: str, percent: int) -> Column:
    """Whether a shared item's place in a set of `size` items counts for a pair of an and bn items.

    Two sets must share o = ceil(t / (1 + t) * (|a| + |b|)) items, so at least
    one of the first |a| - o + 1 and |b| - o + 1.  For sets of about one size
    that is half the prefix that any partner may need: items that only one of
    many near copies has fill it, and what has drifted too far meets nothing.
    """
    needed = F.ceil(percent * (F.col("an") + F.col("bn")) / (100 + percent))
    return F.col(place) < F.col(size) - needed + 1


def _in_both_prefixes(percent: int) -> Column:
    """Whether a shared item counts for a pair of these sizes, which must be close enough."""
    close = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    return close & _in_prefix("ap", "an", percent) & _in_prefix("bp", "bn", percent)


def _crossing_pairs(items: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet on an item within the prefixes that their sizes call for.

    The documents of a component that are of one size meet others by the least of
    their places, so every row of either join belongs to a pair that is returned:
    a large component costs nothing for what comes near it without meeting it.
    """
    ends = stored(items.groupBy("item", "label", "n").agg(F.min("place").alias("p")), "item-components")
    one, two = (ends.select("item", F.col("label").alias(f"{side}_label"), F.col("n").alias(f"{side}n"), F.col("p").alias(f"{side}p")) for side in "ab")
    meeting = one.join(two, "item").where((F.col("a_label") < F.col("b_label")) & _in_both_prefixes(percent)).drop("ap", "bp")
    left, right = (items.select("item", F.col("label").alias(f"{side}_label"), F.col("n").alias(f"{side}n"), F.col("node").alias(side), F.col("place").alias(f"{side}p")) for side in "ab")
    own = meeting.join(left, ["item", "a_label", "an"]).where(_in_prefix("ap", "an", percent))
    return own.join(right, ["item", "b_label", "bn"]).where(_in_prefix("bp", "bn", percent)).select("a", "b").distinct()


def _sets(width: int, wanted):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = in_filter(wanted.value, batch.column(1).to_numpy())
            for block in tb.blocks([batch.filter(pa.array(chosen))], limit=BLOCK):
                items, counts = shingle_sets(block, width)
                yield pa.RecordBatch.from_arrays([block.batch.column(0), tb.list_array(pa.array(items.view(np.int64)), counts)], names=["node", "items"])

    return sets


def _sets_of(rows: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The sets of the documents in pairs; a bounded filter keeps other texts out, and the join with the pairs is exact."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().select(F.xxhash64("node").alias("h"))
    wanted = rows.sparkSession.sparkContext.broadcast(hash_filter(nodes, "h", filter_bits(2 * pairs.count())))
    keyed = rows.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    return stored(keyed.mapInArrow(_sets(width, wanted), "node long, items array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; integer arithmetic, exact at the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    joined = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    union = F.size("a_items") + F.size("b_items") - F.col("common")
    return joined.withColumn("common", common).where(100 * F.col("common") >= percent * union).select("a", "b")


def _by_prefixes(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs that are still possible when all shared items of both whole prefixes are counted.

    Items shared by documents of two components are open, so those are all.
    """
    own = items.groupBy("node").agg(F.min("n").alias("n"), F.min("level").alias("l"), F.collect_list("item").alias("items"))
    own = stored(own, "prefix-lists")
    left = own.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("l").alias("al"), F.col("items").alias("a_items"))
    right = own.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("l").alias("bl"), F.col("items").alias("b_items"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("met", F.size(F.array_intersect("a_items", "b_items")))
    return joined.where(_possible(percent)).select("a", "b")


def _tries(turn: DataFrame, number: int, tries: int) -> DataFrame:
    """Pairs (a, b) of different components: every document with `tries` documents of one of its items, both drawn by hashes."""
    drawn = F.xxhash64(F.col("node"), F.lit(number))
    first = Window.partitionBy("item").orderBy(drawn, "node")
    partners = turn.select("item", F.col("node").alias("other"), F.col("label").alias("other_label"), F.row_number().over(first).alias("k")).where(F.col("k") <= tries)
    at = F.min_by(F.struct("item", "label"), F.xxhash64("item", "node", F.lit(number))).alias("at")
    own = turn.groupBy("node").agg(at).select("node", "at.item", "at.label")
    met = own.join(partners, "item").where("label <> other_label")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _sketch_of(scanned: DataFrame) -> np.ndarray:
    """The tasks' sketches summed up: in how many documents about an item of each counter occurs."""
    parts = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = scanned.where("part IS NOT NULL").select("part", "counts").repartition(parts, "part").mapInArrow(_add_parts, "part int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in summed.collect():  # at most 4 bytes for each of 2**SKETCH_BITS counters
        sketch[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(bytes(row["counts"]), "<u4")
    return sketch


def _shared_prefixes(rows: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    """The prefix items of all documents that stand in more than one row; stored."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefixes = rows.where("doc_id IS NOT NULL").mapInArrow(_prefixes(spark.sparkContext.broadcast(sketch), width, percent), _PREFIX)
    return stored(prefixes.repartition(parts, "item").sortWithinPartitions("item").mapInArrow(_shared_only, _PREFIX), "prefixes-shared")


def _with_labels(prefixes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return prefixes.withColumn("label", F.col("node"))
    own = labels.select(F.col("node").alias("_node"), "label")
    return prefixes.join(own, prefixes["node"] == own["_node"], "left").withColumn("label", F.coalesce("label", "node")).drop("_node")


def similar_components(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Words are split at ASCII blanks with A-Z lower-cased, and shingles of
    `width` words are compared by 64-bit hashes.  Two documents are linked when
    100 * |intersection| >= percent * |union|; component_id is the smallest
    doc_id that links lead to.  A null text or one without words has an empty
    set and is linked with nothing; rows of one doc_id are one document; a null
    doc_id has no links and a null component_id.  No pair of different sets is
    lost, however large a group is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scanned = stored(rows.mapInArrow(_scan(width), _SCANNED), "sets-scanned")
    sizes = scanned.where("part IS NULL").select("doc_id", "n", "h1", "h2")
    sketch = _sketch_of(scanned)

    # Equal sets: the smallest id stands for all.
    usable = sizes.where("n > 0 AND doc_id IS NOT NULL")
    groups = stored(usable.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "equal-sets")
    copies = stored(usable.join(groups, ["n", "h1", "h2"]).where("doc_id <> first").select(F.col("doc_id").alias("copy"), "first").distinct(), "copies")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = _shared_prefixes(rows, sketch, width, percent)
    single = shared.join(copies, shared["node"] == copies["copy"], "left").select("item", F.coalesce("first", "node").alias("node"), "n", "level", "place")
    single = single.groupBy("item", "node").agg(*(F.min(c).alias(c) for c in ("n", "level", "place")))
    single = stored(single.repartition(parts, "item").sortWithinPartitions("item").mapInArrow(_shared_only, _PREFIX), "prefixes")

    edges = copies.select(F.col("copy").alias("a"), F.col("first").alias("b"))
    labels: DataFrame | None = None
    labelled = single.withColumn("label", F.col("node"))
    for number in range(PIVOT_ROUNDS):
        rank = F.struct("place", "node") if number == 0 else F.struct(F.xxhash64(F.col("node"), F.lit(number)).alias("place"), "node")
        ordered = labelled.select("item", "node", "label", "n", "level", rank.alias("rank")).repartition(parts, "item").sortWithinPartitions("item", "rank").drop("rank")
        met = ordered.mapInArrow(_pivots, "a long, b long, an int, bn int, al byte, bl byte").groupBy("a", "b", "an", "bn", "al", "bl").agg(F.count("*").alias("met"))
        best = met.where(_possible(percent)).groupBy("b").agg(F.max(F.struct("met", F.negative("a").alias("a"))).alias("best"))
        best = stored(best.select(F.negative("best.a").alias("a"), "b"), "pairs")
        links = stored(_verified(best, _sets_of(rows, best, width), percent), "links")
        if not links.isEmpty():
            labels = merged_components(labels, links)
            labelled = stored(_with_labels(single, labels), "prefixes-labelled")

    # Items that many components hold: there the last round's pairs would grow with their square.
    own_sets: DataFrame | None = None
    for number, tries in enumerate(TRIES, PIVOT_ROUNDS):
        crowded = labelled.groupBy("item", "label").count().groupBy("item").count().where(F.col("count") > CROWD).select("item")
        turn = stored(labelled.join(stored(crowded, "crowded-items"), "item"), "crowded-prefixes")
        if turn.isEmpty():
            break
        pairs = stored(_by_prefixes(stored(_tries(turn, number, tries), "pairs"), turn, percent), "pairs")
        if own_sets is None:  # components only grow together, so later rounds have no other documents
            own_sets = _sets_of(rows, turn.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct(), width)
        links = stored(_verified(pairs, own_sets, percent), "links")
        if links.isEmpty():
            break
        labels = merged_components(labels, links)
        labelled = stored(_with_labels(single, labels), "prefixes-labelled")

    spread = labelled.groupBy("item").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("item")
    open_items = stored(labelled.join(stored(spread, "open"), "item"), "open-items")
    pairs = stored(_crossing_pairs(open_items, percent), "pairs")
    pairs = stored(_by_prefixes(pairs, open_items, percent), "pairs")
    rest = stored(_verified(pairs, _sets_of(rows, pairs, width), percent), "links")
    labels = merged_components(labels, edges.unionByName(rest)).select(F.col("node").alias("_node"), "label")
    return sizes.join(labels, sizes["doc_id"] == labels["_node"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, all columns; rows without an id stay."""
    own_id, gone_id = free_names(docs, "own_id", "gone_id")
    gone = similar_components(docs, percent, width, doc_id, text).where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    rows = docs.withColumn(own_id, F.col(doc_id).cast("long"))
    return rows.join(gone, F.col(own_id) == F.col(gone_id), "left_anti").drop(own_id)
