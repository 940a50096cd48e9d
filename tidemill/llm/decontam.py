"""Training documents that hold benchmark items: BM25 retrieval, then overlap.

The test items form a BM25 inverted index, whose impacts are divided by the
score an item gives itself, so that one threshold suits short and long items.
Every passage of every document is a query: windows of 2 * STEP words, each
STEP words further, so that a segment of an item (STEP words at most) lies whole
in one of them. Terms in many segments make up a bounded share of any segment's
score, so a passage that could reach the threshold has some of the other,
essential terms: their short lists, for a whole batch of passages at once, leave
the few that can. For these, block-max WAND returns all segments that reach the
threshold; the text around the passage must then hold the item's question and
its answer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel
from tidemill.llm.work import own_columns, settled, small

STEP = 64
BLOCK = 32
K1, B = 1.2, 0.75
#: Share of a segment's own score that a passage must reach.
THRESHOLD = 0.5
#: Of a segment's score, what the terms outside the essential lists may make up.
REST = 0.35
#: Shares of the question's 5-word shingles and of the answer's words that must be found.
QUESTION, ANSWER = 0.5, 0.5
#: An index covers so many postings; more items make more indexes, each its own pass over the documents.
INDEX_POSTINGS = 500_000
BROADCAST_ROWS = 200_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def question_answer(text: str) -> tuple[str, str]:
    """An item of one text: its last sentence or line is the answer; of a single one, all is the question."""
    parts = [x for x in _SENTENCE.split(text) if x.strip()]
    return (text, "") if len(parts) < 2 else (text[: text.rstrip().rfind(parts[-1].rstrip())], parts[-1])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return kernel.words(texts, kernel.NOT_LETTERS, fold=True)


def _postings(batches):
    """(item, segment, term, tf, length) of each item's segments, a bounded part of the items at a time."""
    for whole in batches:
        for x, y in kernel.runs(whole.column(1)):
            hashes, starts = tokens(whole.column(1)[x:y])
            row = np.repeat(np.arange(y - x), np.diff(starts))
            segment = (np.arange(len(hashes)) - starts[row]) // STEP
            order = np.lexsort((hashes, segment, row))
            row, segment, term = row[order], segment[order], hashes[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1]) | (term[1:] != term[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(row)))
            row, segment, term = row[first], segment[first], term[first]
            length = np.minimum(STEP, np.diff(starts)[row] - segment * STEP)
            columns = [whole.column(0)[x:y].take(pa.array(row)), pa.array(segment.astype(np.int32)), pa.array(term.view(np.int64)), pa.array(tf.astype(np.int32)), pa.array(length.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "segment", "term", "tf", "length"])


@dataclass
class Item:
    id: int
    question: np.ndarray
    answer: np.ndarray
    words: int
    shingled: bool  # whether the question is long enough to be taken as shingles; else it is its words


class Index:
    """Postings of item segments by term, in blocks that know their largest impact."""

    def __init__(self, terms: np.ndarray, segments: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((segments, terms))
        self.segments, self.impacts = segments[order], impacts[order]
        self.terms, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int64)
        self.top = np.maximum.reduceat(self.impacts, first) if len(first) else np.zeros(0)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.lists = []
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            ids, w = self.segments[a:b], self.impacts[a:b]
            cuts = np.arange(0, len(ids), BLOCK)
            # ids, impacts, largest impact and last id of each block
            self.lists.append((ids.tolist(), w.tolist(), np.maximum.reduceat(w, cuts).tolist(), ids[np.append(cuts[1:], len(ids)) - 1].tolist()))

        self.rest = np.zeros(int(segments.max()) + 1 if len(segments) else 0)
        self.essential = np.ones(len(self.terms), dtype=bool)
        for t in np.argsort(-np.diff(self.first), kind="stable").tolist():  # the longest lists first
            ids = self.segments[self.first[t] : self.first[t + 1]]
            if (self.rest[ids] + self.impacts[self.first[t] : self.first[t + 1]]).max() > REST:
                break
            self.rest[ids] += self.impacts[self.first[t] : self.first[t + 1]]
            self.essential[t] = False

    def within_reach(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Of passages given by their distinct essential terms, those in which some segment can reach the threshold."""
        n = np.diff(self.first)[term]
        whose = np.repeat(np.arange(len(term)), n)
        at = self.first[term][whose] + np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)
        pair, k = np.unique(passage[whose] * len(self.rest) + self.segments[at], return_inverse=True)
        score = np.bincount(k, self.impacts[at], len(pair))
        return np.unique(pair[score + self.rest[pair % len(self.rest)] >= threshold - 1e-9] // len(self.rest)) if len(pair) else pair

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term number) of the known words."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        k = np.searchsorted(self.terms, hashes[at])
        k[k == len(self.terms)] = 0
        known = self.terms[k] == hashes[at]
        return at[known], k[known]

    def retrieve(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All segments whose impacts over the query's terms add up to the threshold: block-max WAND."""
        cursors = [[0, k] for k in query]  # place in the term's list, term
        lists, top, out = self.lists, self.top, []
        slack = threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: lists[c[1]][0][c[0]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += top[c[1]]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            segment = lists[cursors[pivot][1]][0][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and lists[cursors[pivot + 1][1]][0][cursors[pivot + 1][0]] == segment:
                pivot += 1
            bound, ahead = 0.0, None  # the largest impacts of the blocks that segment is in
            for c in cursors[: pivot + 1]:
                block = c[0] // BLOCK
                ends = lists[c[1]][3]
                while block < len(ends) and ends[block] < segment:
                    block += 1
                if block < len(ends):
                    bound += lists[c[1]][2][block]
                    ahead = ends[block] if ahead is None else min(ahead, ends[block])
            if bound >= slack:
                if lists[cursors[0][1]][0][cursors[0][0]] == segment:
                    score = sum(lists[c[1]][1][c[0]] for c in cursors[: pivot + 1])
                    if score >= slack:
                        out.append((segment, score))
                    target = segment + 1
                else:
                    target = segment
            else:  # no segment up to the nearest end of a block can reach it, unless a further list joins in
                target = segment + 1 if ahead is None else ahead + 1
                if pivot + 1 < len(cursors):
                    target = min(target, lists[cursors[pivot + 1][1]][0][cursors[pivot + 1][0]])
                target = max(target, segment + 1)
            for c in cursors[: pivot + 1]:
                ids, ends = lists[c[1]][0], lists[c[1]][3]
                block = c[0] // BLOCK
                while block < len(ends) and ends[block] < target:
                    block += 1
                c[0] = max(c[0], block * BLOCK)
                while c[0] < len(ids) and ids[c[0]] < target:
                    c[0] += 1
            cursors = [c for c in cursors if c[0] < len(lists[c[1]][0])]
        return out


def _share(wanted: np.ndarray, found: np.ndarray) -> float:
    return float(np.isin(wanted, found).mean()) if len(wanted) else 1.0


def _shingle_set(hashes: np.ndarray) -> np.ndarray:
    return kernel.shingles(hashes, np.array([0, len(hashes)]))[0]


def matches(texts: pa.Array, index: Index, owner: np.ndarray, items: list[Item]) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(score, question overlap, answer overlap) of each row and item found in it, by their numbers; the best passage counts."""
    return {(a + i, k): found for a, b in kernel.runs(texts) for (i, k), found in _matches(texts[a:b], index, owner, items).items()}


def _matches(texts: pa.Array, index: Index, owner: np.ndarray, items: list[Item]) -> dict[tuple[int, int], tuple[float, float, float]]:
    hashes, starts = tokens(texts)
    at, term = index.find(hashes)
    row = np.searchsorted(starts, at, side="right") - 1
    step = (at - starts[row]) // STEP
    base = np.zeros(len(starts), np.int64)  # passages are numbered through the batch; a row has one for each step it begins
    np.cumsum(-(-np.diff(starts) // STEP), out=base[1:])
    most = max(1, len(index.terms))
    rare = index.essential[term]
    rare_row, rare_step, rare_term = row[rare], step[rare], term[rare]
    passage = np.concatenate([base[rare_row] + rare_step, (base[rare_row] + rare_step - 1)[rare_step > 0]])
    pairs = np.unique(passage * most + np.concatenate([rare_term, rare_term[rare_step > 0]]))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in index.within_reach(pairs // most, pairs % most, THRESHOLD).tolist():
        i = int(np.searchsorted(base, p, side="right")) - 1
        a = int(starts[i]) + (p - int(base[i])) * STEP
        inside = slice(*np.searchsorted(at, [a, min(a + 2 * STEP, int(starts[i + 1]))]))
        hits = index.retrieve(np.unique(term[inside]).tolist(), THRESHOLD)
        for item in {int(owner[s]) for s, _ in hits}:
            it = items[item]
            score = max(x for s, x in hits if owner[s] == item)
            near = hashes[max(int(starts[i]), a - it.words) : min(int(starts[i + 1]), a + 2 * STEP + it.words)]
            question, answer = _share(it.question, _shingle_set(near) if it.shingled else near), _share(it.answer, near)
            if question >= QUESTION and answer >= ANSWER:
                best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), (score, question, answer))
    return best


def _search(*test):
    items = test[-1]

    def search(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [{"id": ids[i], "item_id": items[k].id, "score": s, "question": q, "answer": w} for (i, k), (s, q, w) in sorted(matches(batch.column(1), *test).items())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", batch.schema.field(0).type), ("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    return search


def _clean(*test):
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), dtype=bool)
        out[[i for i, _ in matches(texts, *test)]] = False
        return pa.array(out)

    return clean


def _weighted(items: DataFrame) -> tuple[DataFrame, int]:
    """Postings of items (item, text, answer) with their BM25 weights and shards, and how many shards there are; the statistics are those of all."""
    postings = settled(items.select("item", F.concat_ws(" ", "text", "answer").alias("text")).mapInArrow(_postings, "item bigint, segment int, term bigint, tf int, length int"))
    segments = postings.select("item", "segment", "length").distinct()
    size = segments.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = size["n"], size["mean"] or 1.0
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    shards = max(1, -(-postings.count() // INDEX_POSTINGS))
    return settled(postings.join(df, "term").select("item", "segment", "term", weight.alias("w"), F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))), shards


def _indexes(items: DataFrame):
    """(index, owners of its segments, items) for one shard of the items after the other; a shard's size is bounded, and the caller holds one at a time."""
    weighted, shards = _weighted(items)
    for shard in range(shards):
        rows = weighted.where(F.col("shard") == shard).orderBy("item", "segment", "term").toPandas()
        if not len(rows):
            continue
        w = rows["w"] / rows.groupby(["item", "segment"])["w"].transform("sum")
        segment = rows.groupby(["item", "segment"]).ngroup().to_numpy()
        number, own = np.unique(rows["item"].to_numpy(), return_inverse=True)
        owner = np.zeros(segment.max() + 1, np.int64)
        owner[segment] = own
        index = Index(rows["term"].to_numpy().view(np.uint64), segment, w.to_numpy())
        texts = items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).collect()
        known = {r["item"]: (question_answer(r["text"] or "") if r["answer"] is None else (r["text"] or "", r["answer"])) for r in texts}
        own_items = []
        for k in number.tolist():
            q, a = known[k]
            hashes, starts = tokens(pa.array([q, a]))
            question, long = hashes[: starts[1]], starts[1] >= kernel.SHINGLE
            own_items.append(Item(k, _shingle_set(question) if long else np.unique(question), np.unique(hashes[starts[1] :]), len(hashes), bool(long)))
        yield shards, (index, owner, own_items)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per document row and benchmark item found in it: (id_col, item_id, score, question_overlap, answer_overlap).

    Words are runs of letters and digits, in lower case, so case, punctuation
    and line breaks don't hide an item. Without answer_col the last sentence of
    an item is its answer. Documents without an item have no row; null and empty
    texts hold none; texts of any length are searched whole. Items without words
    or id are passed over; of an item id that repeats, one text counts. An item
    of one word is found in every document that has the word, as it is the whole
    item: leave such items out of the benchmark if that isn't wanted. Repeated
    documents repeat their rows. An empty table of documents or items gives an
    empty result. Nothing of the documents is shuffled: the index, of bounded
    size, goes to the tasks. More items than one index holds take a pass for
    each, whose finds are written before the next index is built.
    """
    given = own_columns(docs, {"id": id_col, "text": text_col})
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id bigint, score double, question double, answer double"
    found = given.sparkSession.createDataFrame([], schema)
    for shards, test in _indexes(_items(benchmark, item_col, item_text, answer_col)):
        here = given.mapInArrow(_search(*test), schema)
        found = found.union(settled(here) if shards > 1 else here)
    return found.select(F.col("id").alias(id_col), "item_id", "score", F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """docs without the rows in which an item is found; all columns stay, and rows with null or empty texts.

    Repeated rows go or stay together, texts of any length are searched whole, an
    item of one word drops every document that has it, and an empty table gives
    an empty result with the same columns. With more than one index, each pass
    writes the digests of the texts that go, and the rows are joined with them at
    the end.
    """
    text = F.col(f"`{text_col}`")
    gone = None
    for shards, test in _indexes(_items(benchmark, item_col, item_text, answer_col)):
        clean = F.arrow_udf(_clean(*test), "boolean")
        if shards == 1:
            return docs.where(clean(text))
        here = settled(docs.select(text.alias("text")).where(~clean("text")).select(F.sha2("text", 256).alias("digest")))
        gone = here if gone is None else gone.union(here)
    if gone is None:
        return docs
    marked = docs.select(F.struct("*").alias("row"), F.sha2(text, 256).alias("digest"))
    return marked.join(small(settled(gone.distinct()), BROADCAST_ROWS), "digest", "left_anti").select("row.*")


def _items(benchmark: DataFrame, item_col: str, item_text: str, answer_col: str | None) -> DataFrame:
    items = own_columns(benchmark, {"item": item_col, "text": item_text, **({"answer": answer_col} if answer_col else {})})
    if not answer_col:
        items = items.withColumn("answer", F.lit(None).cast("string"))
    one = F.struct("text", "answer")
    return settled(items.where("item IS NOT NULL").groupBy(F.col("item").cast("bigint").alias("item")).agg(F.max_by("text", one).alias("text"), F.max_by("answer", one).alias("answer")))
