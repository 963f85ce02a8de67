"""Byte-level BPE encoding and decoding with a pair occurrence index.

A map task cuts its texts at white space, keeps each distinct chunk once, splits
the distinct chunks into pre-tokens and merges all distinct pre-tokens of its
partition together: an index maps every mergeable pair to all its positions, the
lowest active rank is applied to all its positions at once, and the positions of
the pairs that appear beside a merge are added under their ranks.  A pre-token
sees its merges in the same order as if it were merged alone, because merges
never cross pre-tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb

#: The byte-level pre-tokeniser's published pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: White space of ASCII, and a pattern that finds any other.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
OTHER_BLANK = regex.compile(r"[\s--[\t-\r ]]", regex.V1)

#: Bytes that no other white space than ASCII's ends with.
PLAIN = np.ones(256, bool)
PLAIN[0x1C:0x20] = PLAIN[0x80:] = False

#: A task merges when it holds so many distinct bytes or so many chunks, and then forgets both.
HELD_BYTES = 1 << 20
HELD_CHUNKS = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The published byte-to-character table of byte-level BPE, inverted: printable bytes stand for themselves, the rest follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Merges and tokens of a tokenizers JSON file of byte-level BPE."""

    def __init__(self, content: str):
        spec = json.loads(content)
        if spec.get("normalizer") or spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("a plain byte-level BPE file is needed")
        model, alphabet = spec["model"], byte_alphabet()
        if model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("a plain byte-level BPE model is needed")
        ids = model["vocab"]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * self.size
        for token, k in ids.items():
            self.bytes[k] = bytes(alphabet[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, k in self.added.items():
            self.bytes[k] = token.encode()
        # Where the encoder looks for added tokens, and what it does with them, is only this.
        if any("<" not in t["content"] or any(map(str.isspace, t["content"])) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
            raise ValueError("added tokens must hold '<' and take no neighbours")
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.of_byte = np.zeros(256, np.int32)
        for char, b in alphabet.items():
            self.of_byte[b] = ids[char]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int32)
        self.right = np.array([ids[b] for _, b in merges], np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.int64) * self.size + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of_key[at], -1)


def merge_all(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after another, and the number of ids of each piece."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    symbols = vocabulary.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbols)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    if n:
        edges = np.flatnonzero(piece[1:] != piece[:-1])
        after[edges] = -1
        after[-1] = -1
        before[edges + 1] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(places: np.ndarray) -> None:
        """Add the pairs that begin at these places to the index."""
        found = vocabulary.ranks(symbols[places], symbols[after[places]])
        chosen = np.flatnonzero(found >= 0)
        if not len(chosen):
            return
        places, found = places[chosen], found[chosen]
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        starts = [0, *cuts.tolist(), len(found)]
        for a, b, rank in zip(starts, starts[1:], found[starts[:-1]].tolist(), strict=False):
            if (own := index.get(rank)) is None:
                index[rank] = [places[a:b]]
                heapq.heappush(active, rank)
            else:
                own.append(places[a:b])

    note(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        own = index.pop(rank)
        places = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
        a, b = vocabulary.left[rank], vocabulary.right[rank]
        follows = after[places]
        valid = (symbols[places] == a) & (follows >= 0) & (symbols[follows] == b)
        if not valid.all():
            places, follows = places[valid], follows[valid]
        if a == b and len(places) > 1:  # of a run of equal symbols, pairs from the left
            order = np.argsort(places)
            places, follows = places[order], follows[order]
            heads = np.flatnonzero(np.concatenate([[True], places[1:] != follows[:-1]]))
            number = np.arange(len(places)) - np.repeat(heads, np.diff([*heads, len(places)]))
            places, follows = places[number % 2 == 0], follows[number % 2 == 0]
        if not len(places):
            continue
        symbols[places] = vocabulary.merged[rank]
        symbols[follows] = -1
        beyond = after[follows]
        after[places] = beyond
        has = beyond >= 0
        before[beyond[has]] = places[has]
        lefts = before[places]
        note(np.unique(np.concatenate([lefts[lefts >= 0], places[has]])))
    alive = symbols >= 0
    return symbols[alive], np.bincount(piece[alive], minlength=len(pieces))


class _Encoder:
    """Distinct chunks of what a task holds, and their codes in each document."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[bytes, int] = {}
        self.held = 0
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, block: tb.Block) -> None:
        """Cut the block where white space begins; next to other white space than ASCII's it isn't cut."""
        data, offsets = block.data, block.offsets
        blank = BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        whole = np.flatnonzero(np.diff(offsets) > 0)
        for k in whole[np.logical_or.reduceat(~PLAIN[data], offsets[:-1][whole])].tolist() if len(whole) else []:
            if OTHER_BLANK.search(block.doc(k).decode()):
                a, b = offsets[k] + 1, offsets[k + 1]
                cut[a:b] &= PLAIN[data[a - 1 : b - 1]]
        cut[offsets] = True
        places = np.flatnonzero(cut)
        if not len(data):
            self.codes.append(np.zeros(0, np.int32))
            self.counts.append(np.zeros(len(block), np.int64))
            return
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        numbers = np.empty(len(coded.dictionary), np.int32)
        chunks = self.chunks
        for k, chunk in enumerate(coded.dictionary.to_pylist()):
            if (number := chunks.get(chunk)) is None:
                number = chunks[chunk] = len(chunks)
                self.held += len(chunk)
            numbers[k] = number
        self.codes.append(numbers[coded.indices.to_numpy()])
        ends = np.searchsorted(places, offsets)
        self.counts.append(np.diff(ends))

    def encode(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents held and the number of ids of each."""
        pieces: dict[bytes, int] = {}
        parts: list[int] = []  # piece numbers of all chunks; added tokens as -1 - id
        n_parts = []
        v = self.vocabulary
        for chunk in self.chunks:
            text = chunk.decode()
            before = len(parts)
            for k, section in enumerate(v.split_added.split(text)) if v.split_added and "<" in text else ((0, text),):
                if k % 2:
                    parts.append(-1 - v.added[section])
                else:
                    parts += [pieces.setdefault(m.group().encode(), len(pieces)) for m in PATTERN.finditer(section)]
            n_parts.append(len(parts) - before)
        ids, sizes = merge_all(list(pieces), v)
        added = sorted(v.added.values())
        ids = np.concatenate([ids, np.array(added, np.int32)])
        sizes = np.concatenate([sizes, np.ones(len(added), np.int64)])
        part = np.array(parts, np.int64)
        for k, token in enumerate(added):
            part[part == -1 - token] = len(pieces) + k
        starts = np.cumsum(sizes) - sizes
        owner, within = tb.ragged(sizes[part])
        ids = ids[starts[part][owner] + within]
        chunk_of_part = np.repeat(np.arange(len(n_parts)), n_parts)
        sizes = np.bincount(chunk_of_part, weights=sizes[part], minlength=len(n_parts)).astype(np.int64)
        return ids, sizes


def _encode(spec):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Encoder(Vocabulary(spec.value))
        rows: list[pa.RecordBatch] = []

        def lists() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Ids of each block held, and their number in each of its documents."""
            ids, sizes = state.encode()
            starts = np.cumsum(sizes) - sizes
            for codes, counts in zip(state.codes, state.counts, strict=True):
                lengths = sizes[codes]
                owner, within = tb.ragged(lengths)
                total = np.concatenate([[0], np.cumsum(lengths)])
                yield ids[starts[codes][owner] + within], np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
            state.clear()

        def out(batch: pa.RecordBatch, flat: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, tb.list_array(pa.array(flat), counts)], names=[*batch.schema.names, "ids"])

        def flush() -> Iterator[pa.RecordBatch]:
            for batch, own in zip(rows, lists(), strict=True):
                yield out(batch, *own)
            rows.clear()

        for block in tb.blocks(batches):
            batch = block.batch.drop_columns(["text"])
            if len(block.data) > 2 * tb.PIECE:  # one long document: piece by piece
                yield from flush()
                data = block.data
                may_cut = np.zeros(len(data), bool)
                may_cut[1:] = BLANK[data[1:]] & ~BLANK[data[:-1]] & PLAIN[data[:-1]]
                flat = []
                for piece in tb.cut_long(block, may_cut):
                    state.add(piece)
                    flat += [ids for ids, _ in lists()]
                flat = np.concatenate(flat)
                yield out(batch, flat, np.array([len(flat)]))
                continue
            state.add(block)
            rows.append(batch)
            if state.held > HELD_BYTES or sum(map(len, state.codes)) > HELD_CHUNKS:
                yield from flush()
        yield from flush()

    return encode


def _decode(spec):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(spec.value).bytes
        sizes = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(part.schema.get_field_index("ids"))
                ids = lists.flatten().to_numpy()
                lengths = sizes[ids]
                owner, within = tb.ragged(lengths)
                flat = data[starts[ids][owner] + within]
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])]
                texts = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return decode


def _spec(df: DataFrame, path: str):
    """The vocabulary file's content, for the tasks: its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `ids array<int>`: the text's tokens, without special ones added.

    A null or empty text has no ids.  Strings of added tokens in a text become
    those tokens, as in the tokenizers library.  `path` is a tokenizers JSON
    file of byte-level BPE on the driver.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(_spec(docs, path)), rows.drop("text").withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`, the text of `ids`; bytes that are not UTF-8 become U+FFFD, null ids an empty text."""
    return encoded.mapInArrow(_decode(_spec(encoded, path)), encoded.withColumn("decoded", F.lit("")).schema)
