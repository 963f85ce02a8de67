"""Merkle manifest, ranked search and SetSketch components against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard_join, merkle, ranked_search, setsketch
from tests.llm.test_operators import A_Z, TEXTS, brute_components

LEAF = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, k int, digest string, place long"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fan=8):
    def leaf(row, text):
        return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [digest(nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
            out.append(nodes)
        return out

    def steps(tree, at):
        for nodes in tree[:-1]:
            low = at // fan * fan
            yield nodes[low:at], nodes[at + 1 : low + fan]
            at //= fan

    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top, out = levels([trees[g][-1][0] for g in names]), []
    for n, g in enumerate(names):
        for at, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*steps(trees[g], at), *steps(top, n)]
            folded = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                folded = leaf(row, row[4].translate(A_Z))
            for left, right in path:
                folded = digest([*left, folded, *right])
            out.append((row[0], own, trees[g][-1][0], top[-1][0], digest(x for s in path for side in s for x in side), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def make_rows():
    rng = random.Random(3)
    rows = [(k, rng.choice(["web", "Böok", None]), rng.choice(["de", "en", "é", None]), k * 7, t) for k, t in enumerate((t for _, t in TEXTS), 1)]
    rows += [(500, "s", "only", None, "Lone Leaf"), (None, None, "de", 1, "no Id"), (None, "x", "de", 2, None), (7, "web", "de", 49, "again"), (7, "web", "de", 49, "again")]
    return rows


@pytest.mark.parametrize("depth, fan, most", [(3, 8, 1 << 16), (1, 8, 3), (2, 2, 2)])
def test_manifest(spark, depth, fan, most):
    rows = make_rows()
    docs = spark.createDataFrame([(*r, "x", "y", 1, "z", 5) for r in rows], LEAF).repartition(5)
    got = merkle.verified_manifest(docs, depth=depth, fan=fan, most=most).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows, fan)


def test_manifest_of_small_tables(spark):
    assert merkle.verified_manifest(spark.createDataFrame([], LEAF)).count() == 0
    one = merkle.verified_manifest(spark.createDataFrame([(1, "s", "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == digest([]) and one["verified"]
    proof = merkle.manifest(spark.createDataFrame([(k, "s", "en", 3, "abc") for k in range(9)], "doc_id long, source string, lang string, n_chars long, text string")).orderBy("doc_id").collect()
    assert [len(step["left"]) // 64 for step in proof[8]["proof"]] == [0, 1] and [len(step["right"]) // 64 for step in proof[3]["proof"]] == [4, 1]


def test_queue_on_disk():
    rng = random.Random(1)
    messages = [(rng.randrange(40), k) for k in range(500)]
    queue = merkle.LabelQueue(most=7)
    for label, k in messages[:300]:
        queue.push(label, k)
    assert queue.runs and len(queue.held) <= 8
    assert queue.take(queue.first()) == [k for label, k in messages[:300] if label == 0]
    for label, k in messages[300:]:
        queue.push(label + 1, k)
    rest = sorted([(label, k) for label, k in messages[:300] if label] + [(label + 1, k) for label, k in messages[300:]])
    got = []
    while (label := queue.first()) is not None:
        got += [(label, k) for k in queue.take(label)]
    assert got == rest


def test_labels_are_in_post_order():
    labels = sorted((merkle.label_of(level, place, 3), -level, place) for level, n in enumerate((27, 9, 3, 1)) for place in range(n))
    assert [row[0] for row in labels] == list(range(40)) and labels[-1][1:] == (-3, 0) and labels[3][1:] == (-1, 0)


# ranked search

def brute_ranking(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_Z))
    texts = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(term for _, own, _ in texts for term in own)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, own, n in texts:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * ((10**9 * own[term]) // (1000 * own[term] + 12 * m)) for term, times in Counter(words(text)).items() if own[term])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, place, i, -score) for place, (score, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "the of The words abc"), (2, None), (3, ""), (4, "x" * 900), (5, "not there at all zzzz"), (6, "Released under a licence that many texts share"), (6, "of the of"), (None, "one two"), (1, "the of The words abc")]


@pytest.mark.parametrize("options", [{}, {"k": 3, "queries_at_once": 1, "postings_at_once": 40}, {"terms_at_once": 5, "postings_at_once": 300}])
def test_ranking(spark, options):
    docs = [*TEXTS, (None, "one two three"), (5, "of the words twice"), (5, "of the words twice")]
    rng = random.Random(6)
    items = ITEMS + [(10 + k, " ".join(rng.choices((docs[rng.randrange(9, 60)][1] or "a").split() or ["a"], k=60))) for k in range(12)]
    table = spark.createDataFrame([(*d, "x", 0, 0) for d in docs], "doc_id long, text string, item_id string, score long, rank int").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    got = ranked_search.ranked_documents(table, asked, **options)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_ranking(docs, items, options.get("k", 20))


def test_ranking_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_documents(none, asked).count() == 0 and ranked_search.ranked_documents(some, asked.limit(0)).count() == 0


def test_search_looks_at_few_documents():
    """A group of equal documents is settled by its first ids; documents out of reach aren't scored."""
    n = 4000
    term, doc = np.tile([0, 1], n), np.repeat(np.arange(n), 2)
    impact = np.where(term == 0, 5, 3)
    impact[2 * 1234] = 90
    lists = ranked_search.Postings(np.arange(n) * 2, term, doc, impact)
    best = ranked_search.Best(20)
    scored = ranked_search.search_block(lists, np.array([0, 1]), np.array([1, 2]), best)
    assert sorted(best.heap, reverse=True) == [(96, -2468), *((11, -2 * k) for k in range(19))] and scored < 600


def test_long_text_is_ranked_whole(spark):
    text = " ".join(f"w{k % 5000}" for k in range(600_000)) + " needle"
    docs = [(1, text), (2, "needle w1"), (3, "w2")]
    items = [(1, "needle w1 w4999")]
    got = ranked_search.ranked_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_ranking(docs, items)


# setsketch

def sets_of(rng, n, shared):
    common = rng.integers(0, 2**63, shared, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - shared, dtype=np.uint64)])) for _ in "ab"]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    for n, shared in ((2000, 1600), (500, 100), (40, 36), (3, 3)):
        a, b = sets_of(rng, n, shared)
        one, two, both = setsketch.sketch_sets(np.concatenate([a, b, np.union1d(a, b)]), np.array([len(a), len(b), len(np.union1d(a, b))]))
        assert (setsketch.merged(one, two) == both).all()
        sizes = np.array([float(len(a))]), np.array([float(len(b))])
        got = setsketch.estimate(np.array([(one > two).sum()]), np.array([(one < two).sum()]), *sizes)[0]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert got == pytest.approx(true, abs=0.14)


def test_pairs_at_the_threshold_pass_and_far_ones_do_not():
    rng = np.random.default_rng(6)
    n = 200
    for share, least, most in ((0.8, n, n), (0.3, 0, 0)):
        shared = round(500 * 2 * share / (1 + share))
        pairs = [sets_of(rng, 500, shared) for _ in range(n)]
        rows = setsketch.sketch_sets(np.concatenate([s for p in pairs for s in p]), np.array([len(s) for p in pairs for s in p]))
        sizes = np.array([len(p[0]) for p in pairs]), np.array([len(p[1]) for p in pairs])
        passed = setsketch.plausible(rows[::2], rows[1::2], *sizes, 80).sum()
        met = (setsketch.band_values(rows[::2]) == setsketch.band_values(rows[1::2])).any(1).sum()
        assert least <= passed <= most and (share < 0.8 or met == n)


def test_near_components(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(setsketch, "CROWD", 2)
    rare = setsketch._rare_pairs
    monkeypatch.setattr(setsketch, "_rare_pairs", lambda *a: tried.append(1) or rare(*a))
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = list(TEXTS)
    for k in range(60):  # near copies that drift apart around the threshold
        own = list(base)
        for at in rng.sample(range(150), rng.randint(1, 9)):
            own[at] = f"new{k}x{at}"
        texts.append((1000 + k, " ".join(own)))
    docs = spark.createDataFrame([(*t, "x", 1, "l", 2) for t in texts] + [(None, texts[-1][1], "x", 1, "l", 2)], "doc_id long, text string, item string, n int, label string, first long").repartition(4)
    rows = setsketch.near_components(docs).collect()
    want = brute_components(texts, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want and tried
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and len(rows) == len(texts) + 1
    assert setsketch.near_components(docs.limit(0)).count() == 0
    assert jaccard_join.keep_one(docs, width=4).count() == len(set(c for _, c in want.values())) + 1
