import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tidemill.llm import ranking

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return LETTERS.findall((text or "").translate(UPPER))


def brute_force(docs, items, top=20):
    """Every document scored for every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    length = [sum(c.values()) for _, c in counted]
    n, total = sum(x > 0 for x in length), sum(length)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in items:
        scores = []
        for (i, c), size in zip(counted, length, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (100 - 25 + (25 * size * n) // total)))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out |= {(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])}
    return out


def corpus(n, seed, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["É", "é", "ß", "Straße", "don't", "a-b", "X"]
    pick = lambda: words[min(int(rng.expovariate(8 / vocabulary)), len(words) - 1)] if rng.random() < 0.9 else rng.choice(words)
    docs = [(k, " ".join(pick() for _ in range(rng.choice((0, 1, 5, 40, 300))))) for k in range(n)]
    docs += [(n + k, docs[rng.randrange(n // 10)][1]) for k in range(n // 5)]  # ties
    items = [(k, ", ".join(pick() for _ in range(rng.choice((1, 3, 12, 90))))) for k in range(25)]
    return docs, items


def run(spark, docs, items, **settings):
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = ranking.rank_documents(given, spark.createDataFrame(items, "item_id long, text string"), **settings).collect()
    return [(r.item_id, r.rank, r.doc_id, r.score) for r in found]


@pytest.mark.parametrize("seed", (1, 2))
def test_matches_scoring_all_documents(spark, monkeypatch, seed):
    monkeypatch.setattr(ranking, "BLOCK", 50)
    docs, items = corpus(600, seed)
    found = run(spark, docs, items)
    assert len(found) == len(set(found)) and set(found) == brute_force(docs, items)


def test_items_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TERMS_AT_ONCE", 60)
    docs, items = corpus(200, 3)
    assert set(run(spark, docs, items, top=7)) == brute_force(docs, items, 7)


def test_few_documents_are_evaluated_once_good_ones_are_known():
    rng = np.random.default_rng(4)
    n_terms, n = 12, 8_000
    hashes = np.arange(n_terms, dtype=np.uint64)
    items = ranking.Items(np.array([7]), np.array([0, n_terms]), np.arange(n_terms), np.full(n_terms, 1000), hashes, n, 100 * n)
    has = rng.random((n, n_terms)) < 0.3
    row, term = np.nonzero(has)
    best = ranking.Best(items, 20)
    for k in range(0, n, 1_000):
        inside = (row >= k) & (row < k + 1_000)
        best.block(np.arange(k, k + 1_000), np.full(1_000, 100), row[inside] - k, term[inside], np.ones(inside.sum(), np.int64))
    scores = has.sum(axis=1) * 1000 * int(ranking.shares(np.array([1]), np.array([100]))[0])
    assert best.doc[0].tolist() == sorted(range(n), key=lambda k: (-scores[k], k))[:20]
    assert best.evaluated < n / 10


def test_masks_of_many_terms():
    rng = np.random.default_rng(5)
    masks = rng.integers(0, 2, (500, 3)).astype(np.uint64) << np.uint64(60)
    different, group = ranking.distinct(masks)
    assert (different[group] == masks).all() and len(different) == len({tuple(r) for r in masks.tolist()})


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "SHORT, one", "x"), (1, "short one", "y"), (None, "short", "x"), (3, None, "x"), (4, "", "x"), (5, "nowhere", "x"), (6, "short", None)], "item_id long, text string, rank string")
    found = sorted(ranking.rank_documents(odd_docs, items).collect())
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in found} == brute_force(docs, [(1, "SHORT, one"), (6, "short")])
    assert [(r.doc_id, r["rank"]) for r in found if r.item_id == 1][2:] == [(1, 3), (1, 4), (5, 5), (None, 6)]
    assert ranking.rank_documents(no_docs, items).count() == ranking.rank_documents(odd_docs, items.where("false")).count() == 0


def test_blocks_and_batches_change_nothing(monkeypatch):
    docs, _ = corpus(300, 6)
    known = np.unique(ranking.kernel.words(pa.array(["w1 w2 w3 é"]), ranking.kernel.NOT_LETTERS)[0])
    items = ranking.Items(np.array([1, 2]), np.array([0, 3, 4]), np.array([0, 1, 2, 3]), np.array([5, 6, 7, 8]), known, 300, 9_000)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["id", "text"])
    whole = list(ranking._rank(items, 20)([batch]))[0]
    monkeypatch.setattr(ranking, "BLOCK", 7)
    assert list(ranking._rank(items, 20)([batch.slice(0, 100), batch.slice(100)]))[0].equals(whole)
