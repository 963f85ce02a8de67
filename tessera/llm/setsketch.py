"""Near-duplicate components by SetSketch registers: band, estimate, verify.

1. A document's set of word shingles becomes REGISTERS registers.  Each shingle draws an ascending sequence of
   exponentially spaced values and deals them to registers in an order of its own; a register keeps the least value x
   it was dealt as floor(1 - log_BASE x), truncated to 0 .. LIMIT + 1.  Sketches of two sets merge into that of their
   union by taking the larger registers.  A shingle whose next value is too large for the smallest register is done.
2. Equal sets are found by a 128-bit hash; one document stands for all.
3. Bands of ROWS registers are hashed; documents that share a band value are candidates.  Two sets of a similarity of
   0.8 have a register in common with a probability of 0.8, and so two of BANDS bands but for one pair in 25 million.
4. For a pair of candidates the registers in which either is larger and those that are equal have a likelihood at every
   similarity, given both sets' sizes.  A pair goes if the threshold is far less likely than the best estimate.
5. What is left is verified on the documents' full sets.

Links are found in rounds, so that a large group of near copies never meets in pairs: first every document is verified
with one pivot, then documents on bands of many components with drawn partners, and last all pairs that share bands
across the components found.  Bands of many components, where such pairs would grow with their square, are left out of
that: their documents meet on prefixes of their rarest shingles instead, which near copies that have drifted below the
threshold don't share, and go through the same estimate and the same check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.components import merged_components
from tessera.llm.jaccard_join import _SCANNED, _by_prefixes, _crossing_pairs, _scan, _sets_of, _shared_only, _shared_prefixes, _sketch_of, _sums, _tries, _verified, _with_labels, shingle_sets
from tessera.llm.shared import dropped, stored

#: Registers (a power of two), the base and the rate of their values, and the largest untruncated one.
REGISTERS, BASE, RATE, LIMIT = 256, 1.001, 20.0, (1 << 16) - 2
#: Registers of a band; bands of few components that a pair of the last round must share.
ROWS, SHARED = 5, 2
BANDS = REGISTERS // ROWS
#: Difference of log likelihoods from which a pair goes: 5.5 standard deviations.
UNLIKELY = 15.0
BLOCK = 1 << 19
#: Rounds of pivots; then the partners tried in each further round, for bands of more than CROWD components.
PIVOT_ROUNDS, TRIES, CROWD = 2, (8, 16), 8
_STEP = np.uint64(0xD1342543DE82EF95)


def sketch_sets(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers (a row for each set) of sets of 64-bit hashes, `counts` of them in each."""
    out = np.zeros((len(counts), REGISTERS), np.uint16)
    owner = np.repeat(np.arange(len(counts)), counts)
    least = np.zeros(len(counts), np.int64)
    order = tb.mix64(items ^ _STEP)
    start, stride = order & np.uint64(REGISTERS - 1), (order >> np.uint64(32)) | np.uint64(1)
    x = np.zeros(len(items))
    with np.errstate(over="ignore"):
        for k in range(REGISTERS):
            drawn = tb.mix64(items + np.uint64(k + 1) * _STEP)
            uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740992.0
            x = x - np.log(uniform) / (RATE * (REGISTERS - k))
            value = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.int64)
            # Values only grow and registers with them, so what is below the smallest register stays there.
            alive = np.flatnonzero(value > least[owner])
            if not len(alive):
                break
            items, owner, start, stride, x = items[alive], owner[alive], start[alive], stride[alive], x[alive]
            register = (start + np.uint64(k) * stride) & np.uint64(REGISTERS - 1)
            place = owner * REGISTERS + register.astype(np.int64)
            flat = out.reshape(-1)
            np.maximum.at(flat, place, value[alive].astype(np.uint16))
            if k % 4 == 3:
                least = out.min(1).astype(np.int64)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def band_values(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band, with its number, of each row of registers."""
    bands = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    out = np.zeros(bands.shape[:2], np.uint64)
    out += np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = tb.mix64(out * _STEP + bands[:, :, k])
    return out


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of the counts of registers in which a is larger and smaller than b, for sets of n_a and n_b items."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    above, below = _chance(u - v * similarity), _chance(v - u * similarity)
    out = (REGISTERS - larger - smaller) * np.log(np.maximum(1 - above - below, 1e-300))
    return out + larger * np.log(np.maximum(above, 1e-300)) + smaller * np.log(np.maximum(below, 1e-300))


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity, by ternary search: the log likelihood is concave in it."""
    low, high = np.zeros(len(larger)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    for _ in range(40):
        third = (high - low) / 3
        left = log_likelihood(larger, smaller, n_a, n_b, low + third) < log_likelihood(larger, smaller, n_a, n_b, high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of rows of registers may reach the similarity: by sizes for certain, by likelihood but for one in ten million."""
    close = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    best = estimate(larger, smaller, n_a, n_b)
    threshold = np.minimum(percent / 100, np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
    gap = log_likelihood(larger, smaller, n_a, n_b, best) - log_likelihood(larger, smaller, n_a, n_b, threshold)
    return close & ((best >= threshold) | (gap <= UNLIKELY))


_SKETCHED = "doc_id long, n int, h1 long, h2 long, registers binary"


def _sketch(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, limit=BLOCK):
            items, counts = shingle_sets(block, width)
            registers = sketch_sets(items, counts)
            rows = pa.array([r.tobytes() if n else None for r, n in zip(registers, counts.tolist(), strict=True)], pa.binary())
            sums = (_sums(items, counts).view(np.int64), _sums(tb.mix64(items), counts).view(np.int64))
            yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(counts.astype(np.int32)), *map(pa.array, sums), rows], names=["doc_id", "n", "h1", "h2", "registers"])

    return sketch


def sketches(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n, h1, h2 (a 128-bit hash of the set) and the registers as 16-bit integers; null for an empty set."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_sketch(width), _SKETCHED)


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = tb.column_bytes(column)
    return data.view(np.uint16).reshape(-1, REGISTERS)


_BAND = "item long, node long, n int"


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            own = batch.slice(low, 1024)
            values = band_values(_matrix(own.column(2)))
            nodes, n = (np.repeat(own.column(k).to_numpy(), BANDS) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(values.reshape(-1).view(np.int64)), pa.array(nodes), pa.array(n)], names=["item", "node", "n"])


def _plausible(percent: int):
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                own = batch.slice(low, 1024)
                n_a, n_b = (own.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                keep = plausible(_matrix(own.column(4)), _matrix(own.column(5)), n_a, n_b, percent)
                yield own.select(["a", "b"]).filter(pa.array(keep))

    return chosen


def _likely(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers don't rule the similarity out; stored."""
    a, b = (own.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")) for c in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return stored(joined.mapInArrow(_plausible(percent), "a long, b long"), "sketch-likely")


def _close(percent: int):
    return 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")


def _pivot_pairs(labelled: DataFrame, number: int, percent: int) -> DataFrame:
    """(a, b): for every document b the pivot a of another component with which it shares most bands; a band's pivot is drawn by a hash."""
    drawn = F.min(F.struct(F.xxhash64(F.col("node"), F.lit(number)).alias("h"), F.col("node").alias("a"), F.col("n").alias("an"), F.col("label").alias("a_label"))).alias("p")
    pivots = stored(labelled.groupBy("item").agg(drawn).select("item", "p.a", "p.an", "p.a_label"), "sketch-pivots")
    met = labelled.withColumnsRenamed({"node": "b", "n": "bn"}).join(pivots, "item").where((F.col("label") != F.col("a_label")) & _close(percent))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("met"))
    best = counted.groupBy("b").agg(F.max(F.struct("met", F.negative("a").alias("a"))).alias("best"))
    return stored(best.select(F.negative("best.a").alias("a"), "b"), "sketch-pairs")


def _crossing(labelled: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of documents of different components that share SHARED bands of CROWD components at most.

    Similar documents that share fewer of these either share a crowded band too, and meet on their rarest shingles, or
    share one band in all, as one pair in 25 million does.
    """
    spread = labelled.groupBy("item", "label").count().groupBy("item").agg(F.count("*").alias("labels")).where(F.col("labels").between(2, CROWD)).select("item")
    own = stored(labelled.join(stored(spread, "sketch-open"), "item"), "sketch-open-bands")
    one, two = (own.select("item", F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col("label").alias(f"{c}_label")) for c in "ab")
    met = one.join(two, "item").where((F.col("a_label") < F.col("b_label")) & _close(percent))
    return met.groupBy("a", "b").agg(F.count("*").alias("met")).where(F.col("met") >= SHARED).select("a", "b")


def _crowded(labelled: DataFrame) -> DataFrame:
    """The rows of bands of more than CROWD components; stored."""
    many = labelled.groupBy("item", "label").count().groupBy("item").count().where(F.col("count") > CROWD).select("item")
    return stored(labelled.join(stored(many, "crowded-bands"), "item"), "crowded-band-rows")


def _rare_pairs(rows: DataFrame, crowded: DataFrame, labels: DataFrame | None, width: int, percent: int) -> DataFrame:
    """(a, b): pairs of the documents of crowded bands, of different components, that meet on their rarest shingles."""
    own = stored(rows.join(crowded.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text"), "crowded-texts")
    counts = _sketch_of(stored(own.mapInArrow(_scan(width), _SCANNED), "sets-scanned"))
    prefixes = _shared_prefixes(own, counts, width, percent).groupBy("item", "node").agg(*(F.min(c).alias(c) for c in ("n", "level", "place")))
    labelled = stored(_with_labels(stored(prefixes, "prefixes"), labels), "prefixes-labelled")
    spread = labelled.groupBy("item").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("item")
    items = stored(labelled.join(stored(spread, "open"), "item"), "open-items")
    return _by_prefixes(stored(_crossing_pairs(items, percent), "pairs"), items, percent)


def near_components(docs: DataFrame, percent: int = 80, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII blanks with A-Z lower-cased; a set holds the distinct shingles of `width` words, or the
    whole sequence of fewer, by 64-bit hashes.  Documents are linked when 100 * |intersection| >= percent * |union|,
    which is confirmed on full sets for every link between different sets; component_id is the smallest doc_id that
    links lead to, and `kept` whether that is the row's own.  A null text or one without words has an empty set and is
    linked with nothing; rows of one doc_id are one document with the links of all its texts; a null doc_id has no
    links, a null component_id and stays.  Extra columns are not read; an empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sketched = stored(sketches(rows, width), "sketches")
    usable = sketched.where("n > 0 AND doc_id IS NOT NULL")
    groups = usable.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    marked = usable.join(stored(groups, "equal-sets"), ["n", "h1", "h2"], "left")
    copies = stored(marked.where("doc_id <> first").select(F.col("doc_id").alias("copy"), "first").distinct(), "copies")
    columns = ["doc_id", "n", "registers"]
    firsts = marked.where("doc_id = first").dropDuplicates(["n", "h1", "h2"]).select(*columns)
    own = stored(marked.where("first IS NULL").select(*columns).unionByName(firsts), "sketch-sets")

    bands = own.mapInArrow(_bands, _BAND)
    shared = stored(bands.repartition(parts, "item").sortWithinPartitions("item").mapInArrow(_shared_only, _BAND), "sketch-bands")
    labels: DataFrame | None = None
    labelled = shared.withColumn("label", F.col("node"))

    def take(links: DataFrame) -> bool:
        """Adds links to the components and names the bands' rows anew; whether there were any."""
        nonlocal labels, labelled
        if links.isEmpty():
            return False
        labels = merged_components(labels, links)
        labelled = stored(_with_labels(shared, labels), "sketch-labelled")
        return True

    def linked(pairs: DataFrame) -> DataFrame:
        likely = _likely(pairs, own, percent)
        return stored(_verified(likely, _sets_of(rows, likely, width), percent), "links")

    for number in range(PIVOT_ROUNDS):
        take(linked(_pivot_pairs(labelled, number, percent)))
    for number, tries in enumerate(TRIES, PIVOT_ROUNDS):
        turn = _crowded(labelled)
        if turn.isEmpty() or not take(linked(stored(_tries(turn, number, tries), "sketch-pairs"))):
            break
    pairs = _crossing(labelled, percent)
    crowded = _crowded(labelled)
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_rare_pairs(rows, crowded, labels, width, percent)).distinct()
    rest = linked(stored(pairs, "sketch-pairs"))
    equal = copies.select(F.col("copy").alias("a"), F.col("first").alias("b"))
    labels = merged_components(labels, equal.unionByName(rest)).select(F.col("node").alias("_node"), "label")
    dropped(shared, own)
    component = F.coalesce("label", "doc_id")
    out = sketched.join(labels, sketched["doc_id"] == labels["_node"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
