"""Toxicity scores from a factorization machine over hashed terms.

Terms are the words of a text and their first few bytes, each a 64-bit hash, so
that neither a vocabulary nor a language is needed. Two kinds of terms enter the
model: those whose presence alone goes with the label, and the most frequent
ones, whatever they say alone. The machine learns a weight and a factor vector
for each, and scores

    sigmoid(bias + sum w_i / sqrt(n) + sum over pairs <v_i, v_j> / n)

over the n distinct known terms of a text, which is the machine's formula for
rows of unit length; without that the pairs of long texts outgrow everything
else. The pair part learns what weights that add up can't: an insult beside the
mention of a group, where either alone is as frequent in harmless texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel
from tidemill.llm.work import own_columns, settled

PREFIXES = (4, 6, 8)
#: At most so many labelled rows train the model, those first in a seeded order of their ids.
TRAIN_ROWS = 16_384
FACTORS = 8
#: Of five folds by crc32 of the id, the one that nothing is learned from, and the one that settings are chosen on.
FOLDS, HELD_OUT, INNER = 5, 0, 1
#: A term that goes with the label must be in so many training rows, and reach this chi-square (p = 0.001).
LEAST_ROWS, LEAST_CHI2 = 3, 10.83
#: Training takes rows in batches, in a seeded order, for so many rounds over the rows at least.
BATCH, ROUNDS = 128, 4
PART_BYTES = 1 << 18  # text whose terms are counted at once: each of its bytes takes some fifty in hashes
_SALTS = [np.uint64(x) for x in (0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F)]


@dataclass(frozen=True)
class Settings:
    """terms: at most so many that go with the label; frequent: and so many of the most frequent ones; together the model's size. steps: at least so many batches. The defaults were chosen on the fold INNER of the rows that may be learned from."""

    terms: int = 4_096
    frequent: int = 128
    rate: float = 0.3
    steps: int = 500


def document_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each distinct term of each row, ordered by row."""
    *kinds, starts = kernel.words(texts, kernel.NOT_LETTERS, PREFIXES, fold=True)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return _distinct(np.tile(rows, len(kinds)), np.concatenate([h ^ s for h, s in zip(kinds, _SALTS, strict=True)]))


def _distinct(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[new], terms[new]


class Vocabulary:
    """Numbers of known terms; a table of their low bits turns most others away."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.astype(np.uint64))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of each distinct known term of each row."""
        *kinds, starts = kernel.words(texts, kernel.NOT_LETTERS, PREFIXES, fold=True)
        rows, terms = [], []
        for h, salt in zip(kinds, _SALTS, strict=True):
            h = h ^ salt
            at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            k = np.searchsorted(self.terms, h[at])
            k[k == len(self.terms)] = 0
            known = self.terms[k] == h[at] if len(self.terms) else np.zeros(len(at), dtype=bool)
            terms.append(k[known])
            rows.append(np.searchsorted(starts, at[known], side="right") - 1)
        key = np.unique(np.concatenate(rows) << 32 | np.concatenate(terms))
        return key >> 32, key & 0xFFFFFFFF


def fit(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, n_terms: int, rounds: int | None = None, rate: float = Settings.rate, steps: int = Settings.steps, seed: int = 7):
    """Bias, weights and factors by Adagrad on the logistic loss; rows must be sorted. Each batch touches its own terms alone."""
    n = len(y)
    share = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
    bias, bias2 = np.array([np.log(share / (1 - share))]), 1e-6
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))
    w2, v2 = np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6)
    starts = np.searchsorted(rows, np.arange(n + 1))
    rounds = rounds or max(ROUNDS, -(-steps // max(1, -(-n // BATCH))))
    for order in (rng.permutation(n) for _ in range(rounds if len(rows) else 0)):
        for a in range(0, n, BATCH):
            some = np.sort(order[a : a + BATCH])
            size = starts[some + 1] - starts[some]
            row = np.repeat(np.arange(len(some)), size)
            at = np.arange(len(row)) + np.repeat(starts[some] - (np.cumsum(size) - size), size)
            used, k = np.unique(terms[at], return_inverse=True)
            score, inner = raw_scores(row, k, len(some), bias, w[used], v[used])
            error = (1 / (1 + np.exp(-np.clip(score, -700, 700))) - y[some]) / len(some)
            size = np.maximum(1, size)
            own, pairs = np.bincount(k, (error / np.sqrt(size))[row], len(used)), (error / size)[row]
            both = np.stack([np.bincount(k, pairs * (inner[row, f] - v[used[k], f]), len(used)) for f in range(FACTORS)], axis=1)
            w2[used] += own**2
            w[used] -= rate * own / np.sqrt(w2[used])
            v2[used] += both**2
            v[used] -= rate * both / np.sqrt(v2[used])
            bias2 += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias2)
    return [bias, w, v]


def raw_scores(rows: np.ndarray, terms: np.ndarray, n: int, bias: np.ndarray, w: np.ndarray, v: np.ndarray):
    """The formula before the sigmoid for n rows given as (row, term), and the sums of their factors: pairs are half of the square of a sum less the squares."""
    inner = np.stack([np.bincount(rows, v[terms, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(rows, (v**2).sum(axis=1)[terms], n)
    size = np.maximum(1, np.bincount(rows, minlength=n))
    return bias[0] + np.bincount(rows, w[terms], n) / np.sqrt(size) + 0.5 * ((inner**2).sum(axis=1) - squares) / size, inner


def _count(batches):
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in kernel.runs(whole.column(0), PART_BYTES)):
        rows, terms = document_terms(batch.column(0))
        y = batch.column(1).to_numpy(zero_copy_only=False)[rows]
        found, k = np.unique(terms, return_inverse=True)
        toxic = np.bincount(k, y, len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(toxic), pa.array(np.bincount(k, minlength=len(found)) - toxic)], ["term", "toxic", "other"])


def _numbered(vocabulary: np.ndarray):
    def number(batches):
        known = Vocabulary(vocabulary)
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in kernel.runs(whole.column(0))):
            rows, terms = known.find(batch.column(0))
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            lists = [terms[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(lists, pa.binary())], ["id", "y", "terms"])

    return number


def _fit_table(n_terms: int, settings: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
        data, at = kernel.buffers(table["terms"])
        terms = np.frombuffer(data[at[0] : at[-1]].tobytes(), np.int32)
        rows = np.repeat(np.arange(table.num_rows), np.diff(at) // 4)
        bias, w, v = fit(rows, terms, table["y"].to_numpy().astype(float), n_terms, rate=settings.rate, steps=settings.steps)
        return pa.table({"model": pa.array([np.concatenate([bias, w, v.ravel()]).tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, settings: Settings = Settings(), left_out: Sequence[int] = (HELD_OUT,)):
    """(vocabulary, bias, weights, factors) from at most so many of the labelled rows with an id outside the folds that are left out.

    docs: (id, text). labels: (id, y). Of several labels of one id the larger
    counts, of several texts the smallest; null labels, texts and ids don't. Without any usable label every text gets
    a score near 0.
    """
    usable = labels.where("y IS NOT NULL AND id IS NOT NULL").where(~fold(F.col("id")).isin(*left_out)).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    sample = settled(usable.orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.where("text IS NOT NULL").join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # Spark takes the minimum before it shuffles
    known = settled(texts.select("text", "y", "id"))  # bounded by rows
    size = known.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = size["p"] or 0, size["n"]
    counts = known.mapInArrow(_count, "term bigint, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    counts = settled(counts.where(F.col("a") + F.col("b") >= LEAST_ROWS))  # of the terms of bounded rows
    c, d = F.greatest(F.lit(0), F.lit(p) - F.col("a")), F.greatest(F.lit(0), F.lit(n - p) - F.col("b"))
    chi2 = F.pow(F.col("a") * d - F.col("b") * c, F.lit(2)) * n / F.greatest(F.lit(1.0), 1.0 * (F.col("a") + F.col("b")) * (c + d) * (F.col("a") + c) * (F.col("b") + d))
    telling = counts.select("term", chi2.alias("chi2")).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").limit(settings.terms).collect()
    usual = counts.orderBy(F.desc(F.col("a") + F.col("b")), "term").limit(settings.frequent).collect()
    vocabulary = np.unique(np.array([r["term"] for r in (*telling, *usual)], np.int64).view(np.uint64))
    fitted = known.mapInArrow(_numbered(vocabulary), "id bigint, y int, terms binary").groupBy().applyInArrow(_fit_table(len(vocabulary), settings), "model binary").collect()
    if not fitted:
        return vocabulary[:0], np.array([-5.0]), np.zeros(0), np.zeros((0, FACTORS))
    x, m = np.frombuffer(fitted[0]["model"]), len(vocabulary)
    return vocabulary, x[:1], x[1 : 1 + m], x[1 + m :].reshape(m, FACTORS)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, by the remainder of FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Whether an id is in the fold that is never learned from. Null ids: no."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def _scorer(model):
    def score(texts: pa.Array) -> pa.Array:
        vocabulary, bias, w, v = model
        known, raw = Vocabulary(vocabulary), [np.zeros(0)]
        for a, b in kernel.runs(texts, 2 * PART_BYTES):
            raw.append(raw_scores(*known.find(texts[a:b]), b - a, bias, w, v)[0])
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(raw), -700, 700))))

    return F.arrow_udf(score, "double")


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int):
    texts = own_columns(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("bigint"))
    return train(texts, own_columns(labels, {"id": id_col, "y": label_col}).withColumn("id", F.col("id").cast("bigint")), train_rows)


def validate(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), on: int = INNER, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> dict[str, float]:
    """How a model does on the labelled rows of one fold, after learning from the others but that and HELD_OUT: rows, right, found (of toxic rows), wrongly (clean rows taken for toxic) and log_loss.

    Settings are to be compared on INNER, which the contract of a held-out fold
    allows; HELD_OUT gives the figures of the settings that were chosen. Rows
    without a label, an id or a text don't count; with none, all figures are 0.
    """
    texts = own_columns(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("bigint"))
    y = own_columns(labels, {"id": id_col, "y": label_col}).withColumn("id", F.col("id").cast("bigint"))
    score = _scorer(train(texts, y, train_rows, settings, (HELD_OUT, on)))
    known = y.where("y IS NOT NULL").where(fold(F.col("id")) == on).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    scored = texts.where("text IS NOT NULL").join(known, "id").select("y", score("text").alias("score"))
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score"))))
    said, one = F.col("score") >= 0.5, F.col("y") == 1
    share = lambda part, whole: F.coalesce(F.avg(F.when(whole, part.cast("double"))), F.lit(0.0))
    return scored.agg(F.count("*").alias("rows"), share(said == one, F.lit(True)).alias("right"), share(said, one).alias("found"), share(said, ~one).alias("wrongly"), F.coalesce(F.avg(-F.log(clipped)), F.lit(0.0)).alias("log_loss")).first().asDict()


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows that toxicity() predicts 1 for; all columns stay, and nothing is shuffled but for training.

    Null and empty texts get the model's bias and stay unless toxic texts are the
    majority of the labelled ones; repeated rows share their fate; texts of any
    length are scored whole; rows with null ids are judged like others. An empty
    table gives an empty result with the same columns.
    """
    score = _scorer(_model(docs, labels, id_col, text_col, label_col, train_rows))
    return docs.where(score(F.col(f"`{text_col}`")) < 0.5)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: (id_col, held_out, score, predicted).

    score is between 0 and 1 and depends on the whole text alone; empty and null
    texts have no terms and get the model's bias. predicted is 1 from 0.5. Rows
    with equal texts have equal scores, repeated rows stay, null ids count as not
    held out. Texts of any length are scored whole, a part at a time. Other
    columns are not read; an empty table gives an empty result, and with no
    labels to learn from all scores are low.
    """
    score = _scorer(_model(docs, labels, id_col, text_col, label_col, train_rows))
    scored = own_columns(docs, {"id": id_col, "text": text_col}).select("id", score("text").alias("score"))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
