"""Token ids in a content-addressed store.

Layout of a store folder:

- `chunks/kind=once` and `chunks/kind=shared`: Parquet rows (digest, data).  A document's id stream is cut where a
  rolling hash of its last ids meets a condition, so equal passages give equal
  chunks wherever they stand; every distinct chunk is stored once under its
  digest.  `data` holds little-endian ids of `id_bytes` bytes.  Chunks that
  can't have a twin are written where they arise (`once`), the others wait in a
  folder of their own, are shuffled on their digest (`shared`), and that folder
  is removed.
- `recipes/`: one row per document in ascending doc_id order: file part,
  position in the corpus' id stream, number of ids, chunk digests in order and
  the root of their Merkle tree.
- `manifest/`: one row per recipe part: documents, ids, first position, and the
  root of the Merkle tree over its documents.
- `root/`: one row: documents, ids, parts, and the root of the tree over the
  parts' roots.

Reading verifies the tree from the top down: the parts' roots against the
store's, every part's documents with their positions and sizes against its
root, every document's digests against its own, and every chunk against its
digest; a lost, changed or exchanged file is found.  Checksums of documents are
combined from those of chunks, so nothing but digests moves for them;
`read_ids` rebuilds the streams themselves.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.shared import dropped, filter_bits, hash_filter, in_filter, remove, stored

DIGEST = 16
WINDOW = 8
LEAST, MOST = 64, 4096
#: A cut follows an id when this many low bits of the rolling hash are zero.
CUT_BITS = 8

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP = np.zeros(256, bool)
STOP[[33, 44, 46, 58, 59, 63]] = True

CACHED = 1 << 19
_MARK = "\x01"
_ID_VALUES = tb.mix64(np.arange(1 << 16, dtype=np.uint64))


class _Tokens:
    """Ids of chunks between white space, encoded by the library once each.

    The tokenizer drops white space and never joins what it separates, nor an
    ASCII letter with the stop that follows, so ids of a text are those of its
    chunks one after another.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = False
        # Lower-case letters are normal and one word already: the same model without the steps that find that out.
        self.letters, self.ascii = Tokenizer.from_str(spec), Tokenizer.from_str(spec)
        for library in (self.letters, self.ascii):
            library.normalizer = library.post_processor = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # ASCII letters stand for themselves
        self.mark = self._encode([_MARK])[0]
        if len(self.mark) != 1:
            raise ValueError("the tokenizer must have one id for U+0001")
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab(True)
        self.ends = np.zeros(1 + max(vocabulary.values()), bool) if suffix else None
        if suffix:
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self.added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.sizes = self.starts = np.zeros(0, np.int64)

    def _encode(self, texts: list[str], library=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in (library or self.library).encode_batch_fast(texts, add_special_tokens=False)]

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.used += len(ids)
        self.sizes = np.concatenate([self.sizes, sizes])

    def _add(self, chunks: list[bytes]) -> None:
        """Encode new chunks: joined by a mark whose id tells them apart, or alone if they may hold an added token."""
        simple, letters, plain, odd = [], [], [], []
        for c in chunks:
            if c.isalpha() and c.islower():
                simple.append(c)
            else:
                (letters if _is_word(c) else odd if b"<" in c or b"\x01" in c else plain).append(c)
        for own, library in ((simple, self.ascii), (letters, self.letters), (plain, self.library)):
            by_end = library is not self.library and self.ends is not None  # the last id of a word tells that it is
            ids = [self.mark[:0] if by_end else self.mark]
            for at in range(0, len(own), 1000):
                ids += self._encode([(b" ".join(own[at : at + 1000]) if by_end else b" \x01 ".join([*own[at : at + 1000], b""])).decode()], library)
            ids = np.concatenate(ids)
            sizes = np.diff(np.concatenate([[-1], np.flatnonzero(self.ends[ids])])) if by_end else np.diff(np.flatnonzero(ids == self.mark[0])) - 1
            if len(sizes) != len(own):
                raise ValueError("chunks can't be told apart in this tokenizer's output")
            self._append(ids if by_end else ids[ids != self.mark[0]], sizes)
        for c in odd:
            ids = self._encode([c.decode()])[0]
            self._append(ids, np.array([len(ids)]))
        before = len(self.known)
        self.known.update(zip([*simple, *letters, *plain, *odd], range(before, before + len(chunks)), strict=True))

    def encode(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's documents and their number in each; a long document is encoded in pieces."""
        may_cut = BLANK[block.data] if len(block) == 1 else np.zeros(0, bool)
        parts = [self._encode_piece(piece) for piece in tb.cut_long(block, may_cut, 2 * tb.PIECE)]
        if len(parts) == 1:
            return parts[0]
        ids = np.concatenate([p[0] for p in parts])
        return ids, np.array([len(ids)])

    def _encode_piece(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHED:
            self.clear()
        data = block.data
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(block), np.int64)
        raw = data.tobytes()
        if not any(t.encode() in raw for t in self.added):
            data = tb.LOWER[data]
        # White space is left out, and a chunk begins where it was, or where a stop follows a letter.
        full = ~BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = full[1:] & (~full[:-1] | STOP[data[1:]] & LETTER[data[:-1]])
        cut[block.offsets] = True
        before = np.zeros(len(data) + 1, np.int32)
        np.cumsum(full, out=before[1:])
        places = before[cut]
        places = places[np.concatenate([[True], places[1:] != places[:-1]])]
        packed = data[full]
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(packed)])
        coded = array.dictionary_encode()
        own = coded.dictionary.to_pylist()
        known = self.known
        self._add([c for c in own if c not in known])
        number = np.fromiter(map(known.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy()]
        lengths = self.sizes[number]
        total = np.concatenate([[0], np.cumsum(lengths)])
        # Of each id, its place among the ids of all known chunks.
        shift = self.starts[number] - total[:-1]
        flat = self.flat[np.repeat(shift, lengths) + np.arange(total[-1])]
        return flat, np.diff(total[np.searchsorted(places, before[block.offsets])])


def _is_word(chunk: bytes) -> bool:
    """Whether a chunk with other letters than ASCII's is one word that the normaliser leaves as it is: lower case, composed."""
    if chunk.isascii():
        return False
    text = chunk.decode()
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


_LOADED: dict[str, _Tokens] = {}


def _tokens_of(spec: str) -> _Tokens:
    """The tokens of a vocabulary file; a worker process keeps them from task to task."""
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = _Tokens(spec)
    return _LOADED[spec]


def cut_points(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each document, the ends of its chunks, counted in ids from its start."""
    rolling = tb.sequence_hashes(_ID_VALUES[ids & 0xFFFF], WINDOW)
    cuts = np.flatnonzero(rolling & np.uint64((1 << CUT_BITS) - 1) == 0) + WINDOW
    bounds = np.searchsorted(cuts, offsets)
    out = []
    for k in range(len(offsets) - 1):
        size, last, ends = int(offsets[k + 1] - offsets[k]), 0, []
        for at in [*(cuts[bounds[k] : bounds[k + 1]] - offsets[k]).tolist(), size]:
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST and at >= WINDOW or at == size and at > last:
                last = at
                ends.append(at)
        out.append(ends)
    return out


def _node(left: bytes, right: bytes) -> bytes:
    return blake2b(b"\x01" + left + right, digest_size=DIGEST).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary tree over digests; an odd last node moves up as it is."""
    level = digests or [b""]
    while len(level) > 1:
        last = level[-1:] if len(level) % 2 else []
        level = [_node(a, b) for a, b in zip(level[::2], level[1::2], strict=False)] + last
    return level[0]


_SHIFTS: list[np.ndarray] = []


def _shift_tables(n: int) -> list[np.ndarray]:
    """Byte tables that append 1, 2, 4, ... zero bytes to a crc32."""
    while len(_SHIFTS) < n:
        if _SHIFTS:
            columns = _apply(_SHIFTS[-1], _apply(_SHIFTS[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)))
        else:
            one = np.arange(256, dtype=np.uint32)
            for _ in range(8):
                one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
            x = np.uint32(1) << np.arange(32, dtype=np.uint32)
            columns = one[x & np.uint32(255)] ^ (x >> np.uint32(8))
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        table = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for b in range(8):
                table[k] ^= np.where(bits[:, b] == 1, columns[8 * k + b], np.uint32(0))
        _SHIFTS.append(table)
    return _SHIFTS


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def crc_append(crc: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of A+B from those of A and B and the bytes of B."""
    for bit, table in enumerate(_shift_tables(int(size.max(initial=0)).bit_length())):
        crc = np.where((size >> bit) & 1, _apply(table, crc), crc)
    return crc ^ other


_ENCODED = "doc_id long, n_tokens long, ids binary, sizes array<int>, digests array<binary>, root binary"


def _encode_task(spec, end_id: int | None, id_bytes: int):
    kind = np.dtype(f"<u{id_bytes}")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("sizes", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("root", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _tokens_of(spec.value)
        for block in tb.blocks(batches, limit=4 * tb.BLOCK_BYTES):
            ids, counts = tokens.encode(block)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts)])
            data = ids.astype(kind).tobytes()
            streams, sizes, digests, roots = [], [], [], []
            for k, ends in enumerate(cut_points(ids, offsets)):
                at = int(offsets[k]) * id_bytes
                own = [blake2b(data[at + a * id_bytes : at + b * id_bytes], digest_size=DIGEST).digest() for a, b in zip([0, *ends], ends, strict=False)]
                streams.append(data[at : int(offsets[k + 1]) * id_bytes])
                sizes.append(np.diff([0, *ends]).tolist())
                digests.append(own)
                roots.append(merkle_root(own))
            yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(counts), *(pa.array(x, schema.field(c + 2).type) for c, x in enumerate((streams, sizes, digests, roots)))], schema=schema)

    return encode


def _first_half(digests: pa.Array) -> np.ndarray:
    """The first 8 bytes of each digest as an integer."""
    return np.frombuffer(tb.column_bytes(digests)[0], "<i8")[:: DIGEST // 8]


def _pack(bitmap, id_bytes: int):
    schema = pa.schema([("digest", pa.binary()), ("data", pa.binary()), ("repeated", pa.bool_())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests = part.column(2).flatten()
                if not len(digests):
                    continue
                _, places = tb.column_bytes(part.column(0))
                sizes = part.column(1).flatten().to_numpy().astype(np.int64) * id_bytes
                data, _ = tb.column_bytes(part.column(0))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                assert ends[-1] == places[-1] == len(data)
                raw = data.tobytes()
                cut = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, cut, pa.array(in_filter(bitmap.value, _first_half(digests)))], schema=schema)

    return pack


class _Tree:
    """The Merkle root of a stream of leaves, holding one node for each level: the same tree as merkle_root's."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for k, other in enumerate(self.levels):
            if other is None:
                self.levels[k] = node
                return
            node, self.levels[k] = _node(other, node), None
        self.levels.append(node)

    def root(self) -> bytes:
        out = None
        for node in self.levels:
            if node is not None:
                out = node if out is None else _node(node, out)
        return out or b""


def _leaf(doc_id: int | None, start: int, n: int, root: bytes) -> bytes:
    """What a part's tree holds of a document; `start` counts from the part's first id."""
    return blake2b(f"{doc_id},{start},{n},".encode() + root, digest_size=DIGEST).digest()


def _leaves(doc_ids: pa.Array, starts: np.ndarray, sizes: np.ndarray, roots: pa.Array) -> Iterator[bytes]:
    return map(_leaf, doc_ids.to_pylist(), starts.tolist(), sizes.tolist(), roots.to_pylist())


_PLACED = "doc_id long, n_tokens long, row long, root binary, sizes array<int>, digests array<binary>, part int, inside long, part_root binary, n_docs long, first_doc long, last_doc long"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the file part and the ids before each document within it, and at the end a row for the part; rows come in doc_id order."""
    part, before, tree, n_docs, ends = TaskContext.get().partitionId(), 0, _Tree(), 0, []
    schema = None
    for batch in batches:
        n = batch.column(1).to_numpy()
        rows = len(n)
        if not rows:
            continue
        inside = before + np.cumsum(n) - n
        before += int(n.sum())
        n_docs += rows
        ends = [ends[0] if ends else batch.column(0)[0].as_py(), batch.column(0)[rows - 1].as_py()]
        for leaf in _leaves(batch.column(0), inside, n, batch.column(3)):
            tree.add(leaf)
        more = [pa.array(np.full(rows, part, np.int32)), pa.array(inside), pa.nulls(rows, pa.binary()), *(pa.nulls(rows, pa.int64()) for _ in range(3))]
        out = pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "inside", "part_root", "n_docs", "first_doc", "last_doc"])
        schema = out.schema
        yield out
    if schema is not None:
        last = {"n_tokens": before, "part": part, "part_root": tree.root(), "n_docs": n_docs, "first_doc": ends[0], "last_doc": ends[1]}
        yield pa.RecordBatch.from_arrays([pa.array([last.get(f.name)], f.type) for f in schema], schema=schema)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", id_bytes: int = 2) -> None:
    """Encode every text and write a store to `path`.

    `tokenizer` is a tokenizers JSON file on the driver that drops white space;
    `end_id` follows each document; ids must fit `id_bytes` bytes.  A null or
    empty text has no other ids.  Documents of equal doc_id stand in the order of
    their rows, and each is stored; equal texts share their chunks; a null doc_id
    comes first.  A long text is encoded in pieces of a few megabytes; its ids
    and digests are held whole.  An empty table gives a store without rows;
    columns other than `doc_id` and `text` are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    most = max([*_vocabulary(content).values(), end_id or 0])
    if most >= 1 << (8 * id_bytes):
        raise ValueError(f"id {most} doesn't fit {id_bytes} bytes")
    spec = spark.sparkContext.broadcast(content)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    encoded = rows.mapInArrow(_encode_task(spec, end_id, id_bytes), _ENCODED).withColumn("row", F.monotonically_increasing_id())
    encoded = stored(encoded, "encoded", "zstd")

    used = encoded.select(F.explode("digests").alias("digest"))
    repeated = stored(used.groupBy("digest").count().where("count > 1").select("digest"), "repeated-chunks")
    repeated = repeated.mapInArrow(_halves, "half long")
    bitmap = spark.sparkContext.broadcast(hash_filter(repeated, "half", filter_bits(repeated.count())))
    packed = encoded.select("ids", "sizes", "digests").mapInArrow(_pack(bitmap, id_bytes), "digest binary, data binary, repeated boolean")
    kind = F.when(F.col("repeated"), F.lit("pending")).otherwise(F.lit("once"))
    packed.select("digest", "data", kind.alias("kind")).write.partitionBy("kind").parquet(f"{path}/chunks", compression="zstd")
    pending = spark.read.schema("digest binary, data binary, kind string").parquet(f"{path}/chunks").where("kind = 'pending'")
    pending.select("digest", "data").dropDuplicates(["digest"]).write.parquet(f"{path}/chunks/kind=shared", compression="zstd")
    remove(spark, f"{path}/chunks/kind=pending")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = encoded.select("doc_id", "n_tokens", "row", "root", "sizes", "digests").repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    recipes = stored(recipes.mapInArrow(_place, _PLACED), "recipes")
    # One row per part: the only window over all rows here is over those.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = stored(recipes.where("part_root IS NOT NULL").select("part", "n_docs", "first_doc", "last_doc", before.alias("start"), "n_tokens", F.lit(id_bytes).alias("id_bytes"), F.col("part_root").alias("root")), "parts")
    offsets = totals.select("part", F.col("start").alias("offset"))
    placed = recipes.where("part_root IS NULL").join(F.broadcast(offsets), "part").select("part", "doc_id", "row", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "root", "sizes", "digests")
    placed.write.parquet(f"{path}/recipes")
    totals.coalesce(1).write.parquet(f"{path}/manifest")
    own = totals.orderBy("part").collect()  # one row per part, however many documents there are
    top = [(sum(r["n_docs"] for r in own), sum(r["n_tokens"] for r in own), len(own), id_bytes, bytearray(merkle_root([bytes(r["root"]) for r in own])))]
    spark.createDataFrame(top, "n_docs long, n_tokens long, n_parts long, id_bytes int, root binary").coalesce(1).write.parquet(f"{path}/root")
    dropped(encoded, recipes, totals)


def _vocabulary(content: str) -> dict[str, int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content).get_vocab(True)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_first_half(batch.column(0)))], names=["half"])


def _checked(id_bytes: int, with_data: bool = False):
    kind = np.dtype(f"<u{id_bytes}")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_buffer()
                if blake2b(raw, digest_size=DIGEST).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} doesn't match its digest")
                ids = np.frombuffer(raw, kind).astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
            more = [batch.column(1)] if with_data else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), *more], names=["digest", "n", "crc", "data"][: 3 + len(more)])

    return check


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from their chunks' checksums, after the Merkle root has been compared."""
    for batch in batches:
        lists = batch.column(4)
        counts = lists.value_lengths().to_numpy()
        flat = lists.flatten()
        place, n, crc = (flat.field(k).to_numpy() for k in (0, 2, 3))
        owner, within = tb.ragged(counts)
        order = np.lexsort((place, owner))
        n, crc = n[order], crc[order].astype(np.uint32)
        digests = np.frombuffer(tb.column_bytes(flat.field(1))[0], np.uint8).reshape(-1, DIGEST)[order].tobytes()
        ends = np.cumsum(counts)
        sizes = np.bincount(owner, weights=n, minlength=len(counts)).astype(np.int64)
        for root, a, b in zip(batch.column(3).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            if merkle_root([digests[k : k + DIGEST] for k in range(a * DIGEST, b * DIGEST, DIGEST)]) != root:
                raise ValueError("a document doesn't match its recipe")
        if (sizes != batch.column(2).to_numpy()).any():
            raise ValueError("a document doesn't match its recipe")
        out = np.zeros(len(counts), np.uint32)
        by_place = np.argsort(within, kind="stable")  # the first chunks of all documents, then the second ones
        for own in np.split(by_place, np.flatnonzero(np.diff(within[by_place])) + 1) if len(by_place) else ():
            out[owner[own]] = crc_append(out[owner[own]], crc[own], n[own] * 4)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of (part, start, row): root, documents, ids and first position of each part, one tree held at a time."""
    at, tree, n_docs, first, n_tokens, done = None, None, 0, 0, 0, []
    for batch in batches:
        part, start, n = (batch.column(k).to_numpy() for k in (0, 2, 3))
        heads = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
        for a, b in zip(heads, heads[1:], strict=False):
            if part[a] != at:
                if tree is not None:
                    done.append((at, n_docs, first, n_tokens, tree.root()))
                at, tree, n_docs, first, n_tokens = int(part[a]), _Tree(), 0, int(start[a]), 0
            for leaf in _leaves(batch.column(1).slice(a, b - a), start[a:b] - first, n[a:b], batch.column(4).slice(a, b - a)):
                tree.add(leaf)
            n_docs += b - a
            n_tokens += int(n[a:b].sum())
    if tree is not None:
        done.append((at, n_docs, first, n_tokens, tree.root()))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names=["part", "n_docs", "start", "n_tokens", "root"])


def verified_recipes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The recipes and the bytes of an id, after the manifest and every part's root have been compared.

    The driver holds one row per part.
    """
    top = spark.read.parquet(f"{path}/root").first()
    listed = {r["part"]: (r["n_docs"], r["start"], r["n_tokens"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").collect()}
    sums = [sum(v[k] for v in listed.values()) for k in (0, 2)]
    if [top["n_docs"], top["n_tokens"], top["n_parts"]] != [*sums, len(listed)] or merkle_root([listed[k][3] for k in sorted(listed)]) != bytes(top["root"]):
        raise ValueError("the manifest doesn't match the store's root")
    recipes = spark.read.schema("part int, doc_id long, row long, start long, n_tokens long, root binary, sizes array<int>, digests array<binary>").parquet(f"{path}/recipes")
    ordered = recipes.select("part", "doc_id", "start", "n_tokens", "root", "row").repartition(max(1, len(listed)), "part").sortWithinPartitions("part", "start", "row")
    found = ordered.mapInArrow(_part_roots, "part int, n_docs long, start long, n_tokens long, root binary").collect()
    if {r["part"]: (r["n_docs"], r["start"], r["n_tokens"], bytes(r["root"])) for r in found} != listed:
        raise ValueError("recipes don't match the manifest")
    return recipes, top["id_bytes"]


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, data binary, kind string").parquet(f"{path}/chunks").select("digest", "data")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from a store and verified.

    The checksum is crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    recipes, id_bytes = verified_recipes(spark, path)
    chunks = _chunks(spark, path).mapInArrow(_checked(id_bytes), "digest binary, n long, crc long")
    used = recipes.select("row", F.posexplode("digests").alias("place", "digest"))
    own = used.join(chunks, "digest").groupBy("row").agg(F.collect_list(F.struct("place", "digest", "n", "crc")).alias("chunks"))
    rows = recipes.select("row", "doc_id", "start", "n_tokens", "root").join(own, "row", "left")
    rows = rows.select("doc_id", "start", "n_tokens", "root", F.coalesce("chunks", F.array().cast(own.schema["chunks"].dataType)).alias("chunks"))
    return rows.mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the stream itself (`ids binary`), rebuilt from verified recipes and chunks."""
    recipes, id_bytes = verified_recipes(spark, path)
    chunks = _chunks(spark, path).mapInArrow(_checked(id_bytes, True), "digest binary, n long, crc long, data binary")
    used = recipes.select("row", F.posexplode("digests").alias("place", "digest"))
    own = used.join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "data"))).alias("chunks"))
    joined = recipes.join(own, "row", "left")
    whole = F.aggregate("chunks", F.lit(b""), lambda a, c: F.concat(a, c["data"]))
    return joined.select("doc_id", "start", "n_tokens", F.coalesce(whole, F.lit(b"")).alias("ids"))
