"""Merkle manifest of a dataset, with a membership proof for every row.

The nodes of each tree are labelled in post-order, so that children come before their parents.  A forward sweep takes
the labels in ascending order: every node sends its digest to its parent through a priority queue ordered by label,
and a parent is made when the queue delivers what its children sent.  The sweep back takes the labels in descending
order and sends each node's proof, its siblings' digests level by level up to the root, down to its children.  The
queue keeps a bounded number of messages in memory and the rest in sorted runs on the task's disk.

Spark cuts the sweeps up: the rows' places come from a range partitioning, FAN ** DEPTH neighbouring places form a
block, a task sweeps its blocks one after another, and the blocks' top nodes are the leaves of the next round, until
each group has one node; groups then are the leaves of the topmost tree.  No task and no round holds a whole group.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.shared import dropped, stored

FAN = 8
#: Levels that one round makes: a block has FAN ** DEPTH leaves.
DEPTH = 3
#: Messages that a queue holds in memory.
IN_MEMORY = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class LabelQueue:
    """A priority queue of (label, number, message): beyond `most`, what is held goes to a sorted run on disk."""

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.held, self.sent = most, [], 0
        self.runs: list[tuple] = []  # the next message of each run, the run's number and its file

    def push(self, label: int, message) -> None:
        heapq.heappush(self.held, (label, self.sent, message))
        self.sent += 1
        if len(self.held) > self.most:
            file = tempfile.TemporaryFile()
            for entry in sorted(self.held):
                pickle.dump(entry, file)
            self.held.clear()
            file.seek(0)
            self._advance(file)

    def _advance(self, file) -> None:
        try:
            entry = pickle.load(file)
        except EOFError:
            file.close()
            return
        heapq.heappush(self.runs, (*entry[:2], entry[2], file))

    def first(self) -> int | None:
        """The least label that waits."""
        return min((heap[0][0] for heap in (self.held, self.runs) if heap), default=None)

    def take(self, label: int) -> list:
        """All messages for a label, which must be the least, in the order in which they were sent."""
        out = []
        while self.first() == label:
            if self.runs and (not self.held or self.runs[0][:2] < self.held[0][:2]):
                _, number, message, file = heapq.heappop(self.runs)
                self._advance(file)
            else:
                _, number, message = heapq.heappop(self.held)
            out.append((number, message))
        return [message for _, message in sorted(out, key=lambda m: m[0])]


def label_of(level: int, place: int, fan: int = FAN) -> int:
    """Post-order label within a block of the node at a level (leaves have 0) and place."""
    leaf = (place + 1) * fan**level - 1
    label, step = leaf + level, fan
    while step <= leaf:
        label += leaf // step
        step *= fan
    return label


def height(n: int, fan: int = FAN) -> int:
    """Levels above `n` leaves."""
    out, size = 0, 1
    while size < n:
        size *= fan
        out += 1
    return out


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


_NODE = "block_key long, block long, n long, level int, place long, digest string, children array<string>"
_NODES = pa.schema([("block_key", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])


def _forward(done: int, fan: int, depth: int, most: int):
    """Rows (block_key, block, n, place, digest) come in that order; a row goes out for each inner node and, as the last of its block, the top.

    `n` is the number of the group's leaves, of whose levels `done` are below this round's.
    """

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        queue, at, n, top = LabelQueue(most), None, 0, None
        levels = 0

        def deliver(before: int | None) -> Iterator[tuple]:
            nonlocal top
            while (label := queue.first()) is not None and (before is None or label < before):
                messages = queue.take(label)
                level, place = messages[0][0], messages[0][1]
                children = [digest for _, _, digest in messages]
                digest = _digest(children)
                yield (*at, n, level, place, digest, children)
                send(level, place, digest)

        def send(level: int, place: int, digest: str) -> None:
            nonlocal top
            if level == levels:
                top = digest
            else:
                queue.push(label_of(level + 1, place // fan, fan), (level + 1, place // fan, digest))

        for batch in batches:
            for key, block, size, place, digest in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (key, block) != at:
                    if at is not None:
                        yield from deliver(None)
                        yield (*at, n, -1, 0, top, None)
                    at, n = (key, block), size
                    levels = max(0, min(depth, height(size, fan) - done))
                place -= block * fan**depth
                yield from deliver(label_of(0, place, fan))
                send(0, place, digest)
        if at is not None:
            yield from deliver(None)
            yield (*at, n, -1, 0, top, None)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in nodes_of(batches):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows, _NODES)
                rows = []
        yield _batch(rows, _NODES)

    return sweep


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _backward(fan: int, depth: int, most: int, row_type: pa.DataType):
    """Rows (block_key, block, label, level, place, children, proof, row) come by block and descending label; a row goes out for each leaf.

    First in a block is what its top node inherits: the digests left and right of each of its ancestors.
    """

    schema = pa.schema([("block_key", pa.int64()), ("place", pa.int64()), ("row", row_type), ("proof", pa.list_(pa.string()))])

    def proofs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        queue, inherited = LabelQueue(most), None
        for batch in batches:
            for key, block, label, level, place, children, proof, row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if level < 0:
                    inherited = proof
                    continue
                if inherited is not None:  # the block's first node is its top
                    queue.push(-label, inherited)
                    inherited = None
                own = queue.take(-label)[0]
                if level == 0:
                    yield key, place + block * fan**depth, row, own
                    continue
                for k in range(len(children)):
                    siblings = ["".join(children[:k]), "".join(children[k + 1 :])]
                    queue.push(-label_of(level - 1, place * fan + k, fan), siblings + own)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in proofs_of(batches):
            rows.append(row)
            if len(rows) == 1024:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)

    return sweep


def _placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with `place`, their number within the group by `order`, and `n`, the group's size.

    A range partitioning puts the rows in order; each partition counts its groups, and only these counts are summed up
    by windows: at most one row for each group and partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    local = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_turn": F.monotonically_increasing_id()}), "merkle-ranged")
    counts = local.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_turn").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_own"), "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    joined = local.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own")))
    out = stored(joined.withColumn("place", F.col("_turn") - F.col("_first") + F.col("_before")).drop("_part", "_turn", "_group", "_own", "_first", "_before"), "merkle-places")
    dropped(local)
    return out


class Forest:
    """Trees over the groups of a table (block_key, place, n, digest, row): the tables of each round."""

    def __init__(self, leaves: DataFrame, fan: int = FAN, depth: int = DEPTH, most: int = IN_MEMORY):
        self.fan, self.depth, self.most = fan, depth, most
        self.parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.leaves, self.nodes, self.row_type = [leaves], [], leaves.schema["row"].dataType
        largest = leaves.agg(F.max("n")).first()[0] or 0
        for number in range(max(1, -(-height(largest, fan) // depth))):
            own = self._blocked(self.leaves[-1]).select("block_key", "block", "n", "place", "digest")
            dealt = own.repartition(self.parts, "block_key", "block").sortWithinPartitions("block_key", "block", "place")
            made = stored(dealt.mapInArrow(_forward(number * depth, fan, depth, most), _NODE), "merkle-nodes")
            self.nodes.append(made.where("level > 0"))
            self.leaves.append(made.where("level = -1").select("block_key", F.col("block").alias("place"), "n", "digest", self._no_row))

    def _blocked(self, leaves: DataFrame) -> DataFrame:
        return leaves.withColumn("block", F.floor(F.col("place") / self.fan**self.depth).cast("long"))

    @property
    def _no_row(self) -> Column:
        return F.lit(None).cast(self.row_type).alias("row")

    @property
    def tops(self) -> DataFrame:
        """(block_key, digest): each group's root."""
        return self.leaves[-1].select("block_key", "digest")

    def proofs(self, inherited: DataFrame) -> DataFrame:
        """(block_key, place, row, proof) of all leaves; `inherited` has (block_key, proof) of each group's root."""
        proved = f"block_key long, place long, row {self.row_type.simpleString()}, proof array<string>"
        above = inherited.select("block_key", F.lit(0).cast("long").alias("place"), "proof")
        whole = self.fan**self.depth
        label = F.col("place") - F.col("block") * whole
        for leaves, nodes in zip(reversed(self.leaves[:-1]), reversed(self.nodes), strict=True):
            no_children, no_proof = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
            rows = self._blocked(leaves).withColumn("place", label)
            entries = rows.select("block_key", "block", self._label(F.lit(0), F.col("place")).alias("label"), F.lit(0).alias("level"), "place", no_children.alias("children"), no_proof.alias("proof"), "row")
            inner = nodes.select("block_key", "block", self._label(F.col("level"), F.col("place")).alias("label"), "level", "place", "children", no_proof.alias("proof"), self._no_row)
            tops = above.select("block_key", F.col("place").alias("block"), F.lit((1 << 63) - 1).alias("label"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("place"), no_children.alias("children"), "proof", self._no_row)
            dealt = entries.unionByName(inner).unionByName(tops).repartition(self.parts, "block_key", "block").sortWithinPartitions("block_key", "block", F.desc("label"))
            above = dealt.mapInArrow(_backward(self.fan, self.depth, self.most, to_arrow_type(self.row_type)), proved)
            if leaves is not self.leaves[0]:
                above = stored(above, "merkle-proofs")
        return above

    def _label(self, level: Column, place: Column) -> Column:
        """label_of() as a column."""
        leaf = (place + 1) * F.pow(F.lit(self.fan), level).cast("long") - 1
        label = leaf + level
        for k in range(1, self.depth + 1):
            label = label + F.floor(leaf / self.fan**k).cast("long")
        return label


def field(value: Column) -> Column:
    """A value as `-` if null, else its size in bytes, `:` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carried: dict[str, Column] | None = None, fan: int = FAN, depth: int = DEPTH, most: int = IN_MEMORY) -> DataFrame:
    """One row per row of `docs`: key, group, leaf, subroot, root and proof, an array of (left, right).

    A leaf is the digest of the row's `fields`.  Per group, leaves ascend by key; while there are several nodes, every
    `fan` neighbours become the digest of their digests, and the groups' roots in the order of their names (null
    first) likewise make `root`.  A step of a proof has the siblings' digests left and right of a node, joined, from
    the leaf's run up to the root's.  A null group is a group of its own; null keys come first; rows of one key are
    in the order of their digests, and equal rows are leaves each.  `carried` names further columns of a row to hand
    on, as strings.  A missing field counts as null, other columns are not read, and an empty table has no rows.
    """
    value = {name: F.col(name) if name in docs.columns else F.lit(None) for name in fields}
    extra = {f"c{k}": column.cast("string") for k, column in enumerate((carried or {}).values())}
    rows = docs.select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), leaf_digest([value[name] for name in fields]).alias("digest"), *(c.alias(n) for n, c in extra.items()))
    # Written before the range partitioning, which reads its input twice.
    rows = stored(rows, "merkle-leaves")
    groups = _placed(rows.groupBy("g").count().select("g", F.lit(0).alias("all")), "all", ["g"])
    placed = _placed(rows, "g", ["k", "digest"])
    dropped(rows)
    known = groups.select(F.col("g").alias("_g"), F.col("place").alias("block_key"))
    packed = F.struct("k", "g", F.col("digest").alias("leaf"), *extra).alias("row")
    leaves = stored(placed.join(known, placed["g"].eqNullSafe(known["_g"])).select("block_key", "place", "n", "digest", packed), "merkle-rows")
    dropped(placed)
    trees = Forest(leaves, fan, depth, most)

    tops = trees.tops.select(F.col("block_key").alias("place"), "digest")
    upper = groups.select("place", "n").join(tops, "place").select(F.lit(0).cast("long").alias("block_key"), "place", "n", "digest", F.col("digest").alias("row"))
    above = Forest(stored(upper, "merkle-tops"), fan, depth, most)
    empty = F.array().cast("array<string>").alias("proof")
    root = above.tops.first()  # one row, none for an empty table
    inherited = above.proofs(above.tops.select("block_key", empty)).select(F.col("place").alias("block_key"), F.col("row").alias("subroot"), "proof")
    inherited = stored(inherited, "merkle-inherited")

    proved = trees.proofs(inherited.select("block_key", "proof"))
    steps = F.transform(F.sequence(F.lit(0), F.size("proof") - 2, F.lit(2)), lambda at: F.struct(F.get("proof", at).alias("left"), F.get("proof", at + 1).alias("right")))
    none = F.array().cast("array<struct<left: string, right: string>>")
    out = proved.withColumn("_proof", F.when(F.size("proof") > 0, steps).otherwise(none)).drop("proof").join(inherited.select("block_key", "subroot"), "block_key")
    names = [F.col(f"row.c{k}").alias(name) for k, name in enumerate(carried or {})]
    return out.select(F.col("row.k").alias(key), F.col("row.g").alias(group), F.col("row.leaf").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.col("_proof").alias("proof"), *names)


def lower_ascii(column: str) -> Column:
    return F.translate(F.col(column).cast("string"), UPPER, LOWER)


def verified_manifest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, after some rows' texts were tampered with.

    Where 3 divides the crc32 of the decimal doc_id, the text's A-Z are lower-cased before its leaf is made again; a
    proof then only leads to the root if that changed nothing.  Rows without an id are not tampered with.
    """
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    chosen = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    changed = leaf_digest([lower_ascii(c) if c == "text" else F.col(c) for c in fields])
    proved = manifest(docs, fields=fields, carried={"tampered": F.when(chosen, changed)}, **options)
    all_siblings = F.array_join(F.flatten(F.transform("proof", lambda step: F.array(step["left"], step["right"]))), "")
    read = proved.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return read.select("doc_id", "leaf", "subroot", "root", F.sha2(all_siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
