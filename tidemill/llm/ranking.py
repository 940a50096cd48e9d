"""The best documents for each of many short texts, by a BM25 score in whole numbers.

A first pass counts, over all documents, what the weights need: documents,
words, and in how many documents each term of an item is. The items, with their
weights, then go to the tasks, a part of bounded size at a time. A task takes
its documents in blocks. For each item, a document's matched terms are the bits
of a mask, and documents with equal masks are one group. A mask's score is
bounded by its terms' largest shares in the block; masks are evaluated from the
highest bound down, until the bound falls below the last score that is still
among the best. What a task has found so far carries over to its next block, so
later blocks evaluate few masks. Each task returns its best documents of each
item, and these are merged in two steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm import kernel
from tidemill.llm.work import own_columns, settled

TOP = 20
#: A document's score sums weight * (SCALE * tf div (1000 * tf + 12 * m)), m growing by B percent with its length over the mean.
SCALE, B = 1_000_000_000, 25
#: Items' terms that go to the tasks at once; more take further passes over the documents.
TERMS_AT_ONCE = 500_000
#: A block has so many documents.
BLOCK = 4_096
#: Groups of one item whose best are merged first, so that what many tasks have found doesn't meet in one.
SALTS = 32
_LAST = np.iinfo(np.int64).max  # stands for a null id, which comes after all others


def _item_terms(batches):
    for batch in batches:
        hashes, starts = kernel.words(batch.column(1), kernel.NOT_LETTERS)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(hashes.view(np.int64))], ["item", "term"])


class Terms:
    """Numbers of known terms by their hashes; a table of the hashes' low bits turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # sorted
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each row; row, term and number of each known term in it, ordered by row)."""
        hashes, starts = kernel.words(texts, kernel.NOT_LETTERS)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        k = np.searchsorted(self.hashes, hashes[at])
        k[k == len(self.hashes)] = 0
        known = self.hashes[k] == hashes[at] if len(self.hashes) else np.zeros(len(at), dtype=bool)
        row = np.searchsorted(starts, at[known], side="right") - 1
        key, tf = np.unique(row << 32 | k[known], return_counts=True)
        return np.diff(starts), key >> 32, key & 0xFFFFFFFF, tf


def _count(hashes: np.ndarray):
    def count(batches):
        terms, df, docs, words = Terms(hashes), np.zeros(len(hashes), np.int64), 0, 0
        for batch in batches:
            for a, b in kernel.runs(batch.column(0)):
                n, _, term, _ = terms.counts(batch.column(0)[a:b])
                docs, words = docs + int(np.count_nonzero(n)), words + int(n.sum())
                df += np.bincount(term, minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [docs, words]))], ["term", "n"])

    return count


@dataclass
class Items:
    """Items and their terms: of item i those from first[i] to first[i + 1], as numbers of hashes, with the terms' weights times their repeats."""

    ids: np.ndarray
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    hashes: np.ndarray
    docs: int
    words: int


def part_of(length: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents with so many words."""
    return 100 - B + (B * length * docs) // max(1, words)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _parts(docs: DataFrame, items: DataFrame):
    """Items in parts of bounded size, with the weights that all documents give them."""
    terms = settled(items.mapInArrow(_item_terms, "item bigint, term bigint").groupBy("item", "term").agg(F.count("*").alias("repeats")))
    parts = -(-terms.count() // TERMS_AT_ONCE)
    for part in range(parts):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow()
        item, term = rows["item"].to_numpy(), rows["term"].to_numpy().view(np.uint64)
        hashes, number = np.unique(term, return_inverse=True)
        order = np.lexsort((number, item))
        ids, first = np.unique(item[order], return_index=True)
        found = docs.select("text").mapInArrow(_count(hashes), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
        seen = {r["term"]: r["n"] for r in found}
        n, total = seen.get(-1, 0), seen.get(-2, 0)
        own = np.array([weight(n, seen.get(k, 0)) for k in range(len(hashes))], np.int64)
        yield parts, Items(ids, np.append(first, len(order)), number[order], own[number[order]] * rows["repeats"].to_numpy()[order], hashes, n, total)


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 12 * m)


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: Items, top: int):
        self.items, self.top = items, top
        self.score = [np.zeros(0, np.int64) for _ in items.ids]
        self.doc = [np.zeros(0, np.int64) for _ in items.ids]
        self.evaluated = 0  # documents whose scores were worked out

    def _take(self, i: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score[i], score]), np.concatenate([self.doc[i], doc])
        order = np.lexsort((doc, -score))[: self.top]
        self.score[i], self.doc[i] = score[order], doc[order]

    def block(self, ids: np.ndarray, length: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents by id and number of words, and their known terms."""
        m = part_of(length, self.items.docs, self.items.words)
        order = np.argsort(term, kind="stable")
        row, term, tf = row[order], term[order], tf[order]
        start = np.searchsorted(term, np.arange(len(self.items.hashes) + 1))
        most = np.zeros(len(self.items.hashes), np.int64)
        here = np.flatnonzero(start[1:] > start[:-1])
        if len(here):
            most[here] = np.maximum.reduceat(tf, start[here])
        least = int(m.min()) if len(m) else 0
        for i in range(len(self.items.ids)):
            self._item(i, ids, m, row, tf, start, most, least)

    def _item(self, i: int, ids, m, row, tf, start, most, least: int) -> None:
        own = slice(self.items.first[i], self.items.first[i + 1])
        term, w = self.items.term[own], self.items.weight[own]
        used = (start[term + 1] > start[term]) & (w > 0)
        term, w = term[used], w[used]
        bound = w * shares(most[term], least)
        full = len(self.score[i]) == self.top
        if not len(term) or (full and bound.sum() < self.score[i][-1]):
            return
        times = np.zeros((len(ids), len(term)), np.int64)
        for j, t in enumerate(term.tolist()):
            times[row[start[t] : start[t + 1]], j] = tf[start[t] : start[t + 1]]
        bits = np.packbits(times > 0, axis=1)
        masks = np.zeros((len(ids), -(-bits.shape[1] // 8)), np.uint64)
        masks.view(np.uint8)[:, : bits.shape[1]] = bits
        matched = np.flatnonzero(masks.any(axis=1))
        different, group = distinct(masks[matched])
        most_of = (np.unpackbits(different.view(np.uint8), axis=1)[:, : len(term)].astype(np.int64) * bound).sum(axis=1)
        by_bound = np.argsort(-most_of[group], kind="stable")
        matched, most_of = matched[by_bound], most_of[group][by_bound]  # documents, those of the best masks first
        a = 0
        while a < len(matched):
            if len(self.score[i]) == self.top and most_of[a] < self.score[i][-1]:
                break
            b = max(a + self.top, int(np.searchsorted(-most_of, -most_of[a], side="right")))  # all of the next mask, and a few more at least
            some = matched[a:b]
            score = (w * shares(times[some], m[some, None])).sum(axis=1)
            self.evaluated += len(some)
            self._take(i, score[score > 0], ids[some][score > 0])
            a = b

    def table(self) -> pa.RecordBatch:
        n = [len(x) for x in self.doc]
        doc = np.concatenate([*self.doc, np.zeros(0, np.int64)])
        columns = [pa.array(np.repeat(self.items.ids, n)), pa.array(doc, mask=doc == _LAST), pa.array(np.concatenate([*self.score, np.zeros(0, np.int64)]))]
        return pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])


def distinct(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of masks, and for each row which of them it is."""
    order = np.lexsort(masks.T)
    sorted_ = masks[order]
    new = np.ones(len(masks), dtype=bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    group = np.empty(len(masks), np.int64)
    group[order] = np.cumsum(new) - 1
    return np.ascontiguousarray(sorted_[new]), group


def _rank(items: Items, top: int):
    def rank(batches):
        terms, best = Terms(items.hashes), Best(items, top)
        waiting, size = [], 0

        def settle():
            shift = np.cumsum([0, *(len(w[0]) for w in waiting)])
            row = np.concatenate([w[2] + s for w, s in zip(waiting, shift, strict=False)])
            best.block(*(np.concatenate([w[c] for w in waiting]) for c in (0, 1)), row, *(np.concatenate([w[c] for w in waiting]) for c in (3, 4)))
            waiting.clear()

        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy()
            for a, b in kernel.runs(batch.column(1)):
                n, row, term, tf = terms.counts(batch.column(1)[a:b])
                for x in range(0, b - a, BLOCK):  # many empty texts
                    y = min(x + BLOCK, b - a)
                    u, v = np.searchsorted(row, (x, y))
                    waiting.append((ids[a + x : a + y], n[x:y], row[u:v] - x, term[u:v], tf[u:v]))
                    size += y - x
                    if size >= BLOCK:
                        settle()
                        size = 0
        if waiting:
            settle()
        yield best.table()

    return rank


def rank_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """Each item's best documents: (item_col, rank, id_col, score), at most ``top`` with a score above 0.

    Terms are runs of ASCII letters and digits and of all other characters, with
    A-Z in lower case, in whole texts of any length; their 64-bit hashes stand
    for them. Equal scores go by ascending id, null ids last; rows that repeat
    count one by one. Null and empty documents have no terms and no rank. Items
    without an id, or without a term that some document has, have no rows; of an
    item id that repeats, the smallest text counts. Other columns aren't read,
    and an empty table of documents or items gives an empty result. Documents
    don't move; what does is at most ``top`` rows of each item from each task.
    """
    given = own_columns(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("bigint"))
    items = own_columns(benchmark, {"item": item_col, "text": item_text}).where("item IS NOT NULL")
    items = items.groupBy(F.col("item").cast("bigint").alias("item")).agg(F.min("text").alias("text"))
    schema = "item bigint, id bigint, score bigint"
    found = given.sparkSession.createDataFrame([], schema)
    for parts, some in _parts(given, items):
        here = given.mapInArrow(_rank(some, top), schema)
        found = found.union(settled(here)) if parts > 1 else here
    order = [F.desc("score"), F.asc_nulls_last("id")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    first = salted.withColumn("place", place("item", "salt")).where(F.col("place") <= top)
    ranked = first.withColumn("rank", place("item")).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


_LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The query in DuckDB's SQL: every document that shares a term with an item is scored.
SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LETTERS}')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
wanted AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LETTERS}')) AS term FROM benchmark) GROUP BY 1, 2),
held AS (SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN wanted USING (term) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY 1),
scores AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20"""
