"""Ranked lexical search: the best documents of every query, by best-first intervals over range-maximum tables.

1. A pass over all documents counts them, their terms, and the documents of every query term.
2. In a second pass each task builds posting lists of the query terms over blocks of its documents in the order of
   their ids.  A posting holds the term's contribution to the document's score, its impact, and every list has a sparse
   table that gives the posting of largest impact of any range in constant time.
3. For a query a block is one interval of documents.  The impacts that range-maximum queries find in an interval, summed
   up over the query's terms, bound the score of every document in it.  The interval with the largest bound comes next:
   it is split at the document of its largest single impact, which is scored, and both parts get bounds of their own;
   the few documents of a short interval are all scored.  A query is done with a block when no bound reaches its
   least score so far, which is carried from block to block.
4. A task's best rows of each query meet in two rounds of ranking.

Queries come in blocks, so that a block's terms and its best rows fit into every task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.shared import dropped, stored

#: Terms are runs of ASCII digits and letters and of bytes that are not ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Expected distinct terms of all queries of a block, expected queries of a block, postings of a block of documents.
TERMS_AT_ONCE, QUERIES_AT_ONCE, POSTINGS = 200_000, 2000, 250_000
#: Intervals of so many documents or fewer are scored whole.
SHORT = 128
#: Partial rankings that a query's final ranking reads.
SALTS = 64


def _terms(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, document and hash of every term of a block, whose A-Z become lower case."""
    block.data = tb.LOWER[block.data]
    starts, ends, doc = tb.spans(block, TERM)
    return starts, ends, doc, tb.span_hashes(block.data, starts, ends)


class Vocabulary:
    """The distinct terms of a block of queries: hashes in ascending order and the terms' bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64) if terms else np.zeros(0, np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = tb.span_hashes(data, starts, ends)
        order = np.argsort(hashes, kind="stable")
        if (hashes[order][1:] == hashes[order][:-1]).any():
            raise ValueError("two query terms have one hash")
        self.hashes, self.data, self.starts, self.lengths = hashes[order], data, starts[order], (ends - starts)[order]
        self.terms = [terms[k] for k in order]

    def __len__(self) -> int:
        return len(self.hashes)

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms of the vocabulary, by hash and then by bytes, and the terms' numbers."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        at = np.flatnonzero((self.hashes[place] == hashes) & (self.lengths[place] == ends - starts))
        term = place[at]
        same = np.ones(len(at), bool)
        for low in range(0, len(at), 1 << 14):
            own = slice(low, low + (1 << 14))
            owner, number = tb.ragged(self.lengths[term[own]])
            differs = data[starts[at[own]][owner] + number] != self.data[self.starts[term[own]][owner] + number]
            same[low + owner[differs]] = False
        return at[same], term[same]


def _counts(vocabulary):
    """Rows (term, n): documents of each vocabulary term in a task; -1 counts documents with terms, -2 all their terms."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total, documents, terms = np.zeros(len(known), np.int64), 0, 0
        for whole in tb.blocks(batches):
            pairs, some = [], np.zeros(len(whole), bool)
            for block in tb.cut_long(whole, ~TERM):
                starts, ends, doc, hashes = _terms(block)
                terms, some[doc] = terms + len(starts), True
                at, term = known.found(block.data, starts, ends, hashes)
                pairs.append(doc[at] * len(known) + term)
            documents += int(some.sum())
            total += np.bincount(np.unique(np.concatenate(pairs)) % len(known), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some]), pa.int64()), pa.array(np.concatenate([[documents, terms], total[some]]), pa.int64())], names=["term", "n"])

    return counts


class Postings:
    """Posting lists of a block of documents, one after another by term, each in document order, with their sparse tables.

    `keys` is term * documents + document, `best[k][i]` the place of the largest impact of places i to i + 2**k - 1,
    the first of equal ones.
    """

    def __init__(self, ids: np.ndarray, term: np.ndarray, document: np.ndarray, impact: np.ndarray):
        self.ids, self.n = ids, len(ids)
        order = np.argsort(term * self.n + document, kind="stable")
        self.keys, self.document, self.impact = (term * self.n + document)[order], document[order], impact[order]
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.best = np.zeros((max(1, longest.bit_length()), len(order)), np.int32)
        self.best[0] = np.arange(len(order))
        for k in range(1, len(self.best)):
            width = 1 << (k - 1)
            left, right = self.best[k - 1, :-width], self.best[k - 1, width:]
            self.best[k, :-width] = np.where(self.impact[right] > self.impact[left], right, left)

    def ranges(self, terms: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms' postings within documents low to high - 1."""
        return np.searchsorted(self.keys, terms * self.n + low), np.searchsorted(self.keys, terms * self.n + high)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each range of places, none of which is empty."""
        level = np.frexp((high - low).astype(np.float64))[1].astype(np.int64) - 1
        left, right = self.best[level, low], self.best[level, high - (1 << level)]
        return np.where(self.impact[right] > self.impact[left], right, left)


class Best:
    """The k best (score, -doc_id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, score: int, doc_id: int) -> None:
        entry = (score, -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    @property
    def least(self) -> int:
        """The score below which nothing enters."""
        return self.heap[0][0] if len(self.heap) == self.k else 0

    def may_enter(self, bound: int, first_id: int) -> bool:
        """Whether a document of at most this score and at least this id may be among the best."""
        return bound > 0 and (len(self.heap) < self.k or (bound, -first_id) > self.heap[0])


def search_block(postings: Postings, terms: np.ndarray, times: np.ndarray, best: Best, short: int = SHORT) -> int:
    """Adds a block's documents to a query's best ones; returns how many were scored."""
    scored = 0
    waiting: list[tuple[int, int, int, int]] = []  # minus the bound, the interval, and where to split it

    def enter(low: int, high: int, a: np.ndarray, b: np.ndarray) -> None:
        """An interval of documents that some query terms have in places a to b - 1."""
        own = np.flatnonzero(b > a)
        if not len(own):
            return
        top = postings.largest(a[own], b[own])
        parts = postings.impact[top] * times[own]
        bound = int(parts.sum())
        if best.may_enter(bound, int(postings.ids[low])):
            # Of equal bounds the smaller ids come first, so that ties are settled without a look at all of them.
            heapq.heappush(waiting, (-bound, low, high, int(postings.document[top[parts.argmax()]])))

    enter(0, postings.n, *postings.ranges(terms, 0, postings.n))
    while waiting:
        bound, low, high, split = heapq.heappop(waiting)
        if not best.may_enter(-bound, int(postings.ids[low])):
            break  # nor may any later interval: its bound is less, or its ids are larger
        a, b = postings.ranges(terms, low, high)
        if high - low <= short:
            owner, number = tb.ragged(b - a)
            places = a[owner] + number
            scores = np.zeros(high - low, np.int64)
            np.add.at(scores, postings.document[places] - low, postings.impact[places] * times[owner])
            for k in np.flatnonzero(scores >= max(1, best.least)).tolist():
                best.add(int(scores[k]), int(postings.ids[low + k]))
            scored += high - low
            continue
        middle, after = postings.ranges(terms, split, split + 1)
        here = after > middle
        best.add(int((postings.impact[middle[here]] * times[here]).sum()), int(postings.ids[split]))
        scored += 1
        enter(low, split, a, middle)
        enter(split + 1, high, after, b)
    return scored


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """weight * ((10**9 * tf) div (1000 * tf + 12 * m)) with m = 75 + (25 * n * documents) div terms, in 64-bit integers."""
    m = 75 + (25 * n * documents) // terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _ranked(shared, k: int, postings_at_once: int):
    """Rows (query, doc_id, score): each task's k best documents of every query."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, queries, documents, terms = shared.value
        best = [Best(k) for _ in queries]
        held: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            if not held:
                return
            ids, doc, term, tf, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            lists = Postings(ids[order], term, rank[doc], impacts(weight[term], tf, n[doc], documents, terms))
            for query, own in zip(queries, best, strict=True):
                search_block(lists, query[0], query[1], own)

        base, count = 0, 0
        for whole in tb.blocks(batches):
            ids = whole.batch.column(0).to_numpy(zero_copy_only=False)
            keys, n = [], np.zeros(len(whole), np.int64)
            for block in tb.cut_long(whole, ~TERM):
                starts, ends, doc, hashes = _terms(block)
                n += np.bincount(doc, minlength=len(whole))
                at, term = known.found(block.data, starts, ends, hashes)
                keys.append(doc[at] * len(known) + term)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            held.append((ids, base + key // len(known), key % len(known), tf.astype(np.int64), n))
            base, count = base + len(whole), count + len(key)
            if count >= postings_at_once:
                search()
                base, count = 0, 0
        search()
        for low in range(0, len(best), 512):
            rows = [(low + q, -i, score) for q, own in enumerate(best[low : low + 512]) for score, i in own.heap]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return ranked


_QUERY_TERMS = "query long, term binary, times long"


def _split_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches):
        starts, ends, doc, hashes = _terms(block)
        # Equal terms of a query stand together and are counted.
        words: dict[tuple[int, bytes], int] = {}
        for d, a, b in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
            word = (d, block.data[a:b].tobytes())
            words[word] = words.get(word, 0) + 1
        numbers = block.batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([numbers[d] for d, _ in words], pa.int64()), pa.array([w for _, w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], names=["query", "term", "times"])


def ranked_documents(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query_text: str = "text", terms_at_once: int = TERMS_AT_ONCE, queries_at_once: int = QUERIES_AT_ONCE, postings_at_once: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query its k best documents with a score above 0, equal scores by doc_id.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), where N counts the documents with a term; a document's
    score sums weight * ((10**9 * tf) div (1000 * tf + 12 * m)) over the query's terms, repeats included, with
    m = 75 + (25 * n * N) div L, n the document's terms and L all documents'.  Terms are compared by bytes.  A null or
    empty text has no terms: as a document it isn't counted, as a query it finds nothing.  Rows of `queries` that
    repeat id and text are one query, rows of one id and several texts are ranked each on its own.  Every row of
    `docs` is a document, repeated ids too; documents without an id are counted but not returned.  Extra columns are
    not read, and empty tables give no rows.

    Documents are read twice for each block of queries; blocks are drawn by a hash so that they have about
    `queries_at_once` queries and `terms_at_once` terms at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    asked = queries.select(F.col(item_id).alias("item_id"), F.col(query_text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "ranked-queries")
    terms = stored(asked.select("query", "text").mapInArrow(_split_queries, _QUERY_TERMS), "ranked-query-terms")
    size = terms.agg(F.count("*").alias("terms"), F.count_distinct("query").alias("queries")).first()
    parts = max(1, -(-size["terms"] // terms_at_once), -(-size["queries"] // queries_at_once))
    schema = "query long, doc_id long, score long"
    found = None
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)
        table = own.orderBy("query", "term").toPandas()  # a block of bounded size
        if not len(table):
            continue
        words = Vocabulary(sorted({bytes(t) for t in table["term"]}))
        shared = spark.sparkContext.broadcast(words)
        counted = rows.select("text").mapInArrow(_counts(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term
        counts = {r["term"]: r["n"] for r in counted}
        documents, length = counts.pop(-1, 0), counts.pop(-2, 0)
        df = np.zeros(len(words), np.int64)
        df[list(counts)] = list(counts.values())
        weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        numbers, plans = _plans(table, words, weight)
        shared = spark.sparkContext.broadcast((words, weight, plans, documents, max(1, length)))
        best = rows.where("doc_id IS NOT NULL").mapInArrow(_ranked(shared, k, postings_at_once), schema)
        named = spark.createDataFrame(pd.DataFrame({"query": np.arange(len(numbers)), "number": numbers}))
        best = _first(best.withColumn("salt", F.spark_partition_id() % SALTS), ["query", "salt"], k).drop("salt", "rank")
        best = stored(_first(best, ["query"], k).join(named, "query").select(F.col("number").alias("query"), "rank", "doc_id", "score"), "ranked-best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    dropped(terms)
    return found.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _plans(table: pd.DataFrame, words: Vocabulary, weight: np.ndarray) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Each query's number, and its terms of some weight with their repeats."""
    place = {term: k for k, term in enumerate(words.terms)}
    numbers, plans = [], []
    for number, own in table.groupby("query", sort=True):
        terms, times = np.array([place[bytes(t)] for t in own["term"]], np.int64), own["times"].to_numpy(np.int64)
        useful = weight[terms] > 0
        numbers.append(int(number))
        plans.append((terms[useful], times[useful]))
    return numbers, plans
