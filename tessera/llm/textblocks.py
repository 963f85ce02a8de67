"""Vectorised helpers over blocks of text, used inside Arrow map tasks.

A *block* is a run of whole documents as one byte array plus offsets.  Blocks
are cut from the Arrow batches Spark hands to a task so that numpy temporaries
stay a few tens of megabytes whatever the batch size; a document longer than a
block forms a block of its own, and what would grow with it by more than a few
bytes per byte works on pieces of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Of a longer document, so many bytes are worked on at a time.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that near inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x += _GOLDEN
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix64(np.arange(256, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(2 * len(_powers[0]), n, 1 << 18)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Block:
    """`batch`: the rows; document k is data[offsets[k]:offsets[k + 1]]."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of about `limit` bytes of whole documents."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            own = offsets[at : end + 1]
            yield Block(batch.slice(at, end - at), data[own[0] : own[-1]], own - own[0])
            at = end


def spans(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which the 256-entry table `inside` is true.

    Runs never cross documents.  Returns starts, ends and each run's document.
    """
    data, offsets = block.data, block.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    flags = inside[data]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens = np.empty(len(flags), bool)
    opens[0] = False
    opens[1:] = flags[:-1]
    opens[full] = False
    starts = np.flatnonzero(flags & ~opens)
    closes = np.empty(len(flags), bool)
    closes[-1] = False
    closes[:-1] = flags[1:]
    closes[full[1:] - 1] = False
    ends = np.flatnonzero(flags & ~closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _running_sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0], out=total[1:])
    return total


def _long_sum(data: np.ndarray) -> np.uint64:
    """The polynomial of a span longer than a piece, summed up piece by piece."""
    out, scale = 0, 1
    for at in range(0, len(data), PIECE):
        out += int(_running_sums(data[at : at + PIECE])[-1]) * scale
        scale = scale * pow(_BASE, PIECE, 1 << 64) % (1 << 64)
    return np.uint64(out % (1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of data[start:end], mixed; equal bytes hash alike anywhere.

    Spans are in order and don't overlap; PIECE bytes are worked on at a time,
    however long a text or a span is.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + PIECE, "right"))
        if to <= at:
            out[at] = _long_sum(data[low : int(ends[at])])
            at += 1
            continue
        total = _running_sums(data[low : int(ends[to - 1])])
        own = starts[at:to] - low
        out[at:to] = (total[ends[at:to] - low] - total[own]) * powers(len(total))[1][own]
        at = to
    return mix64(out)


def cut_long(block: Block, may_cut: np.ndarray, size: int = PIECE) -> Iterator[Block]:
    """A block as it is, or its only document in pieces of about `size` bytes that begin where `may_cut` is true.

    The rows of all pieces are those of the block; without a place to cut a piece is as long as it takes.
    """
    n = len(block.data)
    at = 0
    while n > 2 * size and len(block) == 1 and at < n:
        places = np.flatnonzero(may_cut[at + size : min(at + 2 * size, n)])
        if not len(places) and at + 2 * size < n:
            places = np.flatnonzero(may_cut[at + size : n])
        end = at + size + int(places[0]) if len(places) and n - at > 2 * size else n
        yield Block(block.batch, block.data[at:end], np.array([0, end - at]))
        at = end
    if at == 0:
        yield block


def sequence_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of items[i:i + width] for every i where it fits."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, _ = powers(width + 1)
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total += items[k : k + n] * up[k + 1]
    return mix64(total)


def run_starts(groups: np.ndarray, size: int) -> np.ndarray:
    """Places of groups 0..size in an ascending array of group numbers."""
    return np.searchsorted(groups, np.arange(size + 1))


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c0, c1, ...: the owner of each of sum(c) entries, and its number within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column with `counts` values in each row."""
    places = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=places[1:])
    return pa.ListArray.from_arrays(pa.array(places), values)
