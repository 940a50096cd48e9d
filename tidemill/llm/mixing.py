"""Mixing sources to target weights by fitting each source's word budget.

A source's documents are counted by exact length. Whole repeats come first; the
rest of the budget is a subset sum: every length gives the same share of its
documents, fractions of documents being carried on from length to length so that
rare lengths get theirs too, and a bounded knapsack over the lengths left fits
what remains, to the word where the lengths allow it. It is given a small
remainder first, so that the mix keeps the source's lengths, and where it leaves
words over, more of the budget, up to all of it. Which documents of a length are
taken follows from a seeded hash of their ids. Only counts by length are
gathered, by source; documents of one length are counted in parts of their hash
range, and only those of the part in which the budget ends are ranked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm import kernel
from tidemill.llm.work import own_columns, settled

WEIGHTS = (5, 2, 1)
REPEATS = 3
PARTS = 256
#: The knapsack is first given so many words; the larger part of a budget is dealt out by shares.
KNAPSACK_WORDS = 1 << 11
#: It is given more only up to so many words at once (4 bytes each), and so many bytes of sums to shift.
MOST_WORDS, MOST_BYTES = 1 << 24, 1 << 33


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words to take of each source: all words shared by weight, where none gets more than so many times its own; what that leaves is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, active = float(sum(sizes.values())), order
    while active:
        unit = left / sum(weight[s] for s in active)
        over = [s for s in active if weight[s] * unit > repeats * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in active}
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        active = [s for s in active if s not in out]
    return out


def _shuffled(length: int) -> int:
    return length * 0x9E3779B97F4A7C15 % (1 << 64)


def _pieces(counts: dict[int, int], budget: int) -> list[tuple[int, int]]:
    """(length, how many) whose choices make up every number of each length that fits, in an order that prefers no length."""
    out = []
    for length in sorted((x for x in counts if 0 < x <= budget), key=_shuffled):
        left, piece = min(counts[length], budget // length), 1
        while left > 0:
            piece = min(piece, left)
            out.append((length, piece))
            left -= piece
            piece *= 2
    return out


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take for the largest sum within the budget: bounded knapsack on sets of reachable sums, kept as bits."""
    mask, sums, pieces = (1 << (budget + 1)) - 1, 1, _pieces(counts, budget)
    first = np.full(budget + 1, -1, np.int32)  # the piece that reaches a sum first
    for k, (length, piece) in enumerate(pieces):
        if sums >> budget & 1:
            break
        new = sums << (length * piece) & mask & ~sums
        if new:
            held = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
            for byte in np.array_split(np.flatnonzero(held), 1 + len(held) // 65536):
                bit = np.unpackbits(held[byte][:, None], axis=1, bitorder="little")
                row, column = np.nonzero(bit)
                first[byte[row] * 8 + column] = k
            sums |= new
    at, out = sums.bit_length() - 1, {}
    while at:
        length, piece = pieces[first[at]]
        out[length] = out.get(length, 0) + piece
        at -= length * piece
    return out


def _fit(counts: dict[int, int], budget: int, dealt: int) -> tuple[dict[int, int], bool]:
    """As fit_budget, with so many words dealt by shares and the rest fitted by the knapsack; and whether that wasn't too large to be run."""
    total = sum(length * n for length, n in counts.items())
    taken, carried, left = {}, total // 2, budget
    for length in sorted(counts):  # fractions of documents add up from length to length
        carried += counts[length] * dealt
        taken[length] = min(counts[length], carried // total)
        carried -= taken[length] * total
        left -= taken[length] * length
    for length in sorted(counts, key=_shuffled):
        if left >= 0:
            break
        back = min(taken[length], -(left // length))
        taken[length] -= back
        left += back * length
    rest = {x: counts[x] - n for x, n in taken.items()}
    if left > MOST_WORDS or len(_pieces(rest, left)) * (left // 8) > MOST_BYTES:
        return taken, False
    for length, n in knapsack(rest, left).items():
        taken[length] += n
    return taken, True


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length make up the budget; counts hold at least that many words.

    No choice comes nearer while the knapsack of the whole budget is within
    MOST_WORDS and MOST_BYTES, in units of what divides all lengths. Beyond
    that, what is left over is less than the shortest document not taken.
    """
    unit = math.gcd(*counts)
    if budget <= 0 or not unit:
        return {}
    counts = {length // unit: n for length, n in counts.items() if length and n}
    budget //= unit
    words = lambda taken: sum(length * n for length, n in taken.items())
    best: dict[int, int] = {}
    room = KNAPSACK_WORDS
    while words(best) < budget:
        dealt = max(0, budget - room)
        taken, fitted = _fit(counts, budget, dealt)
        if fitted or not best:
            best = max(best, taken, key=words)
        if not fitted or not dealt:
            break
        room *= 8
    left = budget - words(best)
    for length in sorted(counts, reverse=True):  # only where the knapsack was too large for all of the budget
        more = min(counts[length] - best.get(length, 0), left // length)
        if more > 0:
            best[length] = best.get(length, 0) + more
            left -= more * length
    return {length * unit: n for length, n in best.items()}


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kernel.word_counts(batch.column(2)))], ["id", "source", "size"])


def _targets(weights, repeats):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        named = {(None if k == "" else k[1:]): int(n) for k, n in zip(frame["key"], frame["total"], strict=True)}
        found = source_targets(named, weights, repeats)
        return frame.assign(target=[found[None if k == "" else k[1:]] for k in frame["key"]])

    return run


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    total, target = int(frame["total"].iloc[0]), float(frame["target"].iloc[0])
    whole = int(target // total) if total else 0
    counts = dict(zip(frame["size"].tolist(), frame["n"].tolist(), strict=True))
    more = fit_budget(counts, min(total, round(target - whole * total)))
    return frame[["key", "size"]].assign(whole=np.int32(whole), more=[more.get(s, 0) for s in frame["size"].tolist()])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """One row per row of docs: (id_col, size, source_size, target, taken, source_col).

    size is the number of words, taken the words the mix takes of the document:
    its size times 0 to ``repeats``. Weights go to the sources in code-point
    order, a null source last, repeating. A source's taken words differ from its
    target by less than its shortest useful document. Null and empty texts have
    size 0 and nothing taken. Ids may be null or repeat: rows count one by one,
    and of rows alike in all columns either may be taken. The same rows give the
    same mix; texts of any length count whole. An empty table gives an empty
    result. The lengths of what is taken are those of the source, on average.
    """
    given = own_columns(docs, {"id": id_col, "source": source_col, "text": text_col}).withColumn("source", F.col("source").cast("string"))
    kind = given.schema["id"].dataType.simpleString()
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    rank = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    sized = settled(given.mapInArrow(_sizes, f"id {kind}, source string, size bigint").select("id", key.alias("key"), "size", rank.alias("rank"), F.pmod(F.shiftright(rank, 24), F.lit(PARTS)).cast("int").alias("part")))

    counts = settled(sized.groupBy("key", "size", "part").agg(F.count("*").alias("n")))
    totals = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    targets = settled(totals.groupBy().applyInPandas(_targets(weights, repeats), "key string, total bigint, target double"))
    lengths = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))  # all that one source's task sees
    fitted = lengths.join(targets, "key").groupBy("key").applyInPandas(_plan, "key string, size bigint, whole int, more bigint")
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("part")) - F.col("n")  # over PARTS rows at most
    share = F.least(F.col("n"), F.greatest(F.lit(0), F.col("more") - before))
    plan = settled(counts.join(fitted, ["key", "size"]).select("key", "size", "part", "n", "whole", share.alias("more")))

    planned = sized.join(plan, ["key", "size", "part"])
    row = ["id", "key", "size", (F.col("whole") + F.col("one")).alias("times")]
    # parts that go whole or not at all need no ranks: all but one of a length
    easy = planned.where("more = 0 OR more = n").withColumn("one", (F.col("more") > 0).cast("int")).select(*row)
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("rank", "id"))
    ranked = planned.where("more > 0 AND more < n").withColumn("one", (place <= F.col("more")).cast("int")).select(*row)
    mixed = easy.union(ranked).join(targets, "key")
    taken = F.col("size") * F.col("times")
    return mixed.select(F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target", taken.alias("taken"), F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias(source_col))
