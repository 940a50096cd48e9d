"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles. A document's sketch is its k smallest
hashes, so of two documents with Jaccard similarity s each of the k smallest
hashes of their union lies in both sketches with probability s. A pair at the
threshold therefore shares at least ``need`` retained values but for a chance
below 1e-9, and with the values ordered from rare to common, the two must share
one among the first ``size - need + 1``: only those enter the inverted lists.

Documents that lists connect are dealt to one group, each once, with their full
sets. There, overlap counts from the lists of retained values propose partners,
the sketch of the union estimates the similarity, and exact Jaccard on the full
sets confirms the link. Groups return spanning links, never all pairs. A large
group is worked in blocks of bounded size, each together with the group's first
document. What its links leave outside the group's largest component, the
strays, may be linked to documents of other blocks. There are two ways to find
these, and each group takes the one that moves fewer rows: strays are held
against every block of their group, which suits groups of near copies with few
strays; or against the lists that they are in, which suits documents that have
passages in common and aren't near. Lists are worked with sketches first, each
pair in the first list that the two have in common, and full sets follow for
those that have a partner whose union sketch passes. So a group of copies takes
linear work, however large, and documents that only share passages are dealt
once for each of their retained values, as long as lists fit a block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm import kernel
from tidemill.llm.components import components
from tidemill.llm.work import own_columns, settled, small

SKETCH = 64
#: The chance, at most, that a pair at the threshold shares fewer of the union's smallest values than shared() says.
MISSED = 2e-10
#: The lowest threshold: below it, most of a sketch would have to enter the inverted lists.
LEAST_PERCENT = 80
#: A block has so many documents, and so many shingles, on average at most; a block of a list, so many sketches.
BLOCK, BLOCK_SHINGLES, LIST_BLOCK = 256, 1 << 17, 2048
BROADCAST_ROWS = 200_000
#: What a row is in a block that strays are dealt to: a stray, one of the others they are held against, or both.
STRAY, OTHER, BOTH = 1, 2, 3


def _each(batches):
    """The batches in parts of bounded size, with the sets of shingles of their rows."""
    for batch in batches:
        for a, b in kernel.runs(batch.column(1)):
            yield batch.slice(a, b - a), kernel.shingles(*kernel.words(batch.column(1)[a:b]))


def _sketches(batches):
    for batch, sets in _each(batches):
        heads = [s[:SKETCH].view(np.int64) for s in sets]
        starts = np.zeros(len(sets) + 1, np.int32)
        np.cumsum([len(h) for h in heads], out=starts[1:])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64))),
            ],
            ["id", "n", "print", "sketch"],
        )


def _sets(batches):
    seen = set()  # a set that repeats in a task goes on once
    for batch, sets in _each(batches):
        data = [s.tobytes() for s in sets]
        keys = [hashlib.blake2b(x, digest_size=16).digest() for x in data]
        new = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in new], pa.binary()), pa.array([data[k] for k in new], pa.binary())], ["print", "shingles"])


def shared(percent: int) -> int:
    """How many of the SKETCH smallest values of its union a pair at the threshold shares, but for a chance below MISSED: 33 at 85 percent, 29 at 80."""
    return max(k for k in range(1, SKETCH + 1) if chance_of_missing(percent / 100, k) < MISSED)


def need(n, percent: int = 85):
    """How many retained values a set of n shingles shares with any partner."""
    return F.least(F.lit(shared(percent)), F.ceil(n * percent / F.lit(100)))


def union_estimate(sketch: np.ndarray, others: np.ndarray, filler: np.ndarray) -> np.ndarray:
    """Similarity of one padded sketch to each row of others, from the smallest values of the two together."""
    both = np.sort(np.concatenate([np.broadcast_to(sketch, others.shape), others], axis=1), axis=1)
    twice = np.zeros(both.shape, dtype=bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != filler)
    rank = np.cumsum(~twice, axis=1)  # of the distinct value this entry is
    real = both != filler
    inside = (rank <= SKETCH) & real
    return (twice & inside).sum(axis=1) / np.maximum(1, (inside & ~twice).sum(axis=1))


class Sketches:
    """The sketches of some sets, to find those that can be near one of them."""

    def __init__(self, heads: np.ndarray, none: int, n: np.ndarray, percent: int):
        self.heads, self.none, self.n, self.percent = heads, none, n, percent  # values as numbers that keep the order of the hashes, filled with none
        self.most = shared(percent)
        self.least = np.minimum(self.most, -(-n * percent // 100))
        self.mine = np.zeros(none + 1, dtype=bool)

    def near(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Of rest, by size, by how many retained values it shares with i, and by the sketch of their union."""
        n = self.n
        rest = rest[100 * np.minimum(n[rest], n[i]) >= self.percent * np.maximum(n[rest], n[i])]
        if len(rest):
            head = self.heads[i][self.heads[i] != self.none]
            self.mine[head] = True
            rest = rest[self.mine[self.heads[rest]].sum(axis=1) >= np.maximum(self.least[i], self.least[rest])]
            self.mine[head] = False
        if len(rest):
            floor = self.most / SKETCH if n[i] > SKETCH else self.percent / 100 - 0.2
            rest = rest[union_estimate(self.heads[i], self.heads[rest], np.int32(self.none)) >= floor]
        return rest


def linked(sets: list[np.ndarray], percent: int = 85, group: np.ndarray | None = None, strays: int | None = None, allowed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the sets: pairs of positions with 100 * intersection >= percent * union.

    group: numbers of components that are known already. strays: hold so many
    sets, the first ones, against the others, and nothing else; allowed tells
    which of the others a stray may be held against, by (stray, other).
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    number = number.astype(np.int32)
    at = np.zeros(m + 1, np.int64)
    np.cumsum(n, out=at[1:])
    none = len(values)
    heads = np.full((m, SKETCH), none, np.int32)
    for i in range(m):
        k = min(SKETCH, n[i])
        heads[i, :k] = number[at[i] : at[i] + k]
    sketches = Sketches(heads, none, n, percent)
    group = np.arange(m) if group is None else group.copy()
    mine = np.zeros(none + 1, dtype=bool)
    out = []
    for i in range(m - 1 if strays is None else strays):
        rest = np.arange(i + 1, m) if strays is None else strays + np.flatnonzero(allowed[i])
        rest = sketches.near(i, rest[group[rest] != group[i]])
        if len(rest):
            own = number[at[i] : at[i + 1]]
            mine[own] = True
            for j in rest.tolist():
                if group[j] != group[i]:
                    common = int(np.count_nonzero(mine[number[at[j] : at[j + 1]]]))
                    if 100 * common >= percent * (n[i] + n[j] - common):
                        out.append((i, j))
                        group[group == group[j]] = group[i]
            mine[own] = False
    return out


LINKS = "a bigint, b bigint"


def _as_links(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    found = np.array([(nodes[i], nodes[j]) for i, j in pairs], np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 1], "b": found[:, 0]})


def _shingles(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]


def _link_block(percent: int):
    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        return _as_links(table["node"].to_numpy(), linked(_shingles(table), percent))

    return link


def _strays_first(table: pa.Table):
    """(rows by role, those that have both twice; nodes, number of strays, which of the others each stray may be held against, numbers of components)."""
    table = table.sort_by("node")
    role = table["role"].to_numpy()
    order = np.concatenate([np.flatnonzero(role & STRAY), np.flatnonzero(role & OTHER)])
    table, strays = table.take(pa.array(order)), int(np.count_nonzero(role & STRAY))
    nodes = table["node"].to_numpy()
    stray, block = table["stray"].to_numpy(), table["block"].to_numpy()
    # pairs of one block have been compared already; two strays meet twice
    allowed = (block[strays:] != block[:strays, None]) & (~stray[strays:] | (nodes[strays:] > nodes[:strays, None]))
    return table, nodes, strays, allowed, np.unique(table["component"].to_numpy(), return_inverse=True)[1]


def _link_strays(percent: int):
    def link(table: pa.Table) -> pa.Table:
        table, nodes, strays, allowed, group = _strays_first(table)
        return _as_links(nodes, linked(_shingles(table), percent, group, strays, allowed))

    return link


def _padded(lists: pa.ChunkedArray, width: int) -> tuple[np.ndarray, int]:
    """Lists of hashes as rows of numbers in the order of the hashes, filled with the number that is returned too."""
    lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    values, number = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    out = np.full((len(n), width), len(values), np.int32)
    out[np.arange(width) < n[:, None]] = number
    return out, len(values)


def _promising(percent: int):
    """Of a part of a list, the strays and others that make pairs which can be near, each pair in the first list that the two share."""

    def filtered(table: pa.Table) -> pa.Table:
        table, nodes, strays, allowed, group = _strays_first(table)
        heads, none = _padded(table["sketch"], SKETCH)
        sketches = Sketches(heads, none, table["n"].to_numpy(), percent)
        earlier, nothing = _padded(table["earlier"], SKETCH)
        before, found = np.zeros(nothing + 1, dtype=bool), np.zeros(len(nodes), dtype=bool)
        for i in range(strays):
            rest = strays + np.flatnonzero(allowed[i])
            before[earlier[i]], before[nothing] = True, False
            rest = sketches.near(i, rest[(group[rest] != group[i]) & ~before[earlier[rest]].any(axis=1)])
            before[earlier[i]] = False
            found[rest] = True
            found[i] |= len(rest) > 0
        kept = np.unique(nodes[found])
        return pa.table({"node": kept, "v": np.full(len(kept), table["v"][0].as_py(), np.int64)})

    return filtered


def _largest_apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the groups with several blocks whose links leave strays, with component, stray, and how many blocks of strays there are."""
    known = members.where("blocks > 1").join(roots.select(F.col("id").alias("node"), F.col("root").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = known.groupBy("part", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("part").agg(F.max_by("component", F.struct("size", "component")).alias("main"), (F.sum("size") - F.max("size")).alias("strays"))
    # a block of strays is as large as the part's blocks are on average
    main = small(settled(main.where("strays > 0").select("part", "main", "strays")), BROADCAST_ROWS)
    apart = known.join(main, "part").withColumn("stray", F.col("component") != F.col("main"))
    return apart.select("node", "rep", "print", "n", "part", "blocks", "block", "component", "stray", F.ceil(F.col("strays") / BLOCK).cast("int").alias("stray_blocks"))


def _with_sets(given: DataFrame, dealt: DataFrame) -> DataFrame:
    """dealt with the sets of its rows, from the texts; one row of the id ``rep`` has the set that ``print`` says."""
    texts = given.join(small(dealt.select(F.col("rep").alias("id")), BROADCAST_ROWS), "id", "left_semi")
    return texts.select("id", "text").mapInArrow(_sets, "print binary, shingles binary").join(small(dealt, BROADCAST_ROWS), "print")


def _block_links(given: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links within each block, and with the group's first document."""
    first = F.col("node") == F.col("part")
    places = F.when(first, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = members.select("node", "rep", "print", "part", F.explode(places).alias("block"))
    sets = _with_sets(given, dealt).select("part", "block", "node", "shingles")
    once = sets.repartition("part", "block").dropDuplicates()
    return once.groupBy("part", "block").applyInArrow(_link_block(percent), LINKS)


def _dealt(rows: DataFrame, key: str, place: Column, *more: str) -> DataFrame:
    """Each row to every block of strays, and each stray to every block: (key, i, j, role, ...). place: which of the blocks a row is in."""
    place, own = place.cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("stray_blocks")).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    as_other = F.transform(up_to("stray_blocks"), lambda j: at(place, j, F.when(F.col("stray") & (j == own), BOTH).otherwise(OTHER)))
    others = F.filter(up_to("blocks"), lambda i: F.col("stray") & (i != place))
    as_stray = F.transform(others, lambda i: at(i, own, F.lit(STRAY)))
    return rows.select("node", key, "block", "component", "stray", *more, F.explode(F.concat(as_other, as_stray)).alias("to")).select("*", "to.*").drop("to")


def _stray_links(given: DataFrame, rows: DataFrame, key: str, place: Column, percent: int) -> DataFrame:
    """Links of strays with each block of what they are dealt by: their group, or a list."""
    sets = _with_sets(given, settled(_dealt(rows, key, place, "rep", "print")))
    once = sets.select(key, "i", "j", "role", "node", "block", "component", "stray", "shingles").repartition(key, "i", "j").dropDuplicates()
    return once.groupBy(key, "i", "j").applyInArrow(_link_strays(percent), LINKS)


def _list_sizes(rows: DataFrame, block: int, shingles: int) -> DataFrame:
    """Of each list with a stray and others: its group, blocks of its rows and of its strays, and how often its rows are dealt."""
    stray = F.when(F.col("stray"), 1).otherwise(0)
    blocks = lambda one, n: F.greatest(F.lit(1), F.ceil(F.sum(one) / block), F.ceil(F.sum(n) / shingles)).cast("int")
    sizes = rows.groupBy("part", "v").agg(F.count("*").alias("m"), F.sum(stray).alias("s"), blocks(F.lit(1), F.col("n")).alias("blocks"), blocks(stray, F.col("n") * stray).alias("stray_blocks"))
    return sizes.where("s > 0 AND m > 1").select("part", "v", "blocks", "stray_blocks", (F.col("m") * F.col("stray_blocks") + F.col("s") * (F.col("blocks") - 1)).alias("dealt"))


def _fewer_by_list(by_block: DataFrame, by_list: DataFrame) -> DataFrame:
    """The groups whose strays are dealt fewer times by lists; those without such a list have no links left to find, and go there too."""
    return by_block.join(by_list, "part", "left").where("by_list IS NULL OR by_list < by_block").select("part")


def _links_of_strays(given: DataFrame, apart: DataFrame, prefixes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links of strays with documents of other blocks, by blocks or by lists, whichever takes fewer rows in each group."""
    own = [c for c in apart.columns if c not in ("blocks", "stray_blocks")]
    each = apart.join(prefixes, "node").select(*own, F.posexplode("prefix").alias("at", "v"), F.slice("prefix", 1, F.col("at")).alias("earlier"))
    sizes = settled(_list_sizes(each, LIST_BLOCK, LIST_BLOCK * BLOCK_SHINGLES))  # sketches are of one size
    by_block = apart.groupBy("part").agg(F.sum(F.col("stray_blocks") + F.when(F.col("stray"), F.col("blocks") - 1).otherwise(0)).alias("by_block"))
    fewer = settled(_fewer_by_list(by_block, sizes.groupBy("part").agg(F.sum("dealt").alias("by_list"))))
    if fewer.isEmpty():
        return _stray_links(given, apart, "part", F.col("block"), percent)
    fewer = small(fewer, BROADCAST_ROWS)
    links = _stray_links(given, apart.join(fewer, "part", "left_anti"), "part", F.col("block"), percent)

    in_list = F.pmod(F.xxhash64("node"), F.col("blocks"))
    lists = each.join(fewer, "part", "left_semi").join(sizes.drop("dealt"), ["part", "v"])
    sketched = _dealt(lists, "v", in_list, "earlier").join(classes.select("node", "n", "sketch"), "node")
    promising = settled(sketched.repartition("v", "i", "j").groupBy("v", "i", "j").applyInArrow(_promising(percent), "node bigint, v bigint").distinct())
    rows = each.join(promising, ["node", "v"], "left_semi").drop("earlier")
    rows = settled(rows.join(_list_sizes(rows, BLOCK, BLOCK_SHINGLES).drop("dealt"), ["part", "v"]))
    return links.union(_stray_links(given, rows, "v", in_list, percent))


def _of_one_id(usable: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the texts that share an id: each with the id's least; None if no id has several."""
    several = settled(usable.groupBy("id").agg(F.min("print").alias("least"), F.max("print").alias("print")).where("least < print").select("id", "least"))
    if several.isEmpty():
        return None
    node = classes.select("print", "node")
    pairs = usable.select("id", "print").join(small(several, BROADCAST_ROWS), "id").where("print > least").select("print", "least").distinct()
    return pairs.join(node, "print").join(node.select(F.col("print").alias("least"), F.col("node").alias("other")), "least").select(F.col("other").alias("a"), F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id, kept).

    Links join documents whose sets of 5-word shingles have 100 * intersection
    >= percent * union (percent: LEAST_PERCENT or more). component_id
    is the smallest id that links reach, kept is whether that is the document
    itself. Null and empty texts have no shingles and no links: each is its own
    component. Texts of any length are taken whole; a set alone may be larger than
    a block. Rows without an id link with nothing: component_id is null and
    they are kept. Repeated rows, and rows that share an id, count as one
    document with all their links; different texts of an id are compared one by
    one, so that no task gets them all. Other columns are not read. An empty table
    gives an empty result.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the sketch is sized for thresholds from {LEAST_PERCENT} percent")
    given = own_columns(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("bigint"))
    sketched = settled(given.mapInArrow(_sketches, "id bigint, n bigint, print binary, sketch array<bigint>"))
    usable = sketched.where("n > 0 AND id IS NOT NULL")

    classes = usable.groupBy("print").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = settled(classes.withColumn("node", F.monotonically_increasing_id()))  # settled, so every step sees the same numbers
    entries = classes.select("node", need(F.col("n"), percent).cast("int").alias("need"), F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = entries.join(shared, "v").groupBy("node", "need").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("x"))  # SKETCH values at most
    prefixes = settled(ranked.select("node", F.slice("x.v", 1, F.greatest(F.lit(0), F.size("x") - F.col("need") + 1)).alias("prefix")).where("size(prefix) > 0"))
    prefix = prefixes.select("node", F.explode("prefix").alias("v"))
    hubs = prefix.groupBy("v").agg(F.min("node").alias("hub"))
    near = components(prefix.join(hubs, "v").select(F.col("node").alias("a"), F.col("hub").alias("b"))).select(F.col("id").alias("node"), F.col("root").alias("part"))

    near = near.join(classes.select("node", "rep", "print", "n"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = small(settled(near.groupBy("part").agg(blocks.alias("blocks"))), BROADCAST_ROWS)  # so that a large group's members needn't meet
    members = settled(near.join(sizes, "part").select("node", "rep", "print", "n", "part", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    links = settled(_block_links(given, members, percent))
    roots = components(links)
    apart = settled(_largest_apart(members, roots))
    more = [] if apart.isEmpty() else [settled(_links_of_strays(given, apart, prefixes, classes, percent))]
    if (of_one_id := _of_one_id(usable, classes)) is not None:
        more.append(of_one_id)
    for some in more:
        links = links.union(some)
    if more:
        roots = components(links)

    named = roots.withColumnRenamed("id", "node").join(classes.select("node", "rep"), "node")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component")), "root").select("node", "component")
    # classes are a table of their own here, so that AQE can split the copies of one text
    member = sketched.select("id", "n", "print").join(classes.select("print", F.col("node").alias("class"), "rep"), "print", "left")
    member = member.select("id", "n", "rep", F.when(F.col("id").isNotNull(), F.col("class")).alias("node"))
    out = member.join(named, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs with one document of each group of near duplicates, that with the smallest id; all columns stay.

    Of rows that repeat an id, the one with the smallest text stays. Rows without
    an id, null and empty texts stay; long texts count whole. An empty table
    gives an empty result with the same columns.
    """
    flags = near_duplicates(docs, id_col, text_col, percent).select(F.col(id_col).alias("id"), "kept").where("id IS NOT NULL")
    flags = settled(flags.groupBy("id").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")).where("NOT kept OR rows > 1"))
    marked = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"))
    once = marked.join(small(flags.select("id"), BROADCAST_ROWS), "id", "left_anti").select("row.*")
    again = marked.join(small(flags.where("kept").select("id"), BROADCAST_ROWS), "id", "left_semi")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col(f"row.`{text_col}`")))
    return once.union(again.withColumn("place", first).where("place = 1").select("row.*"))


def chance_of_missing(threshold: float = 0.85, least: int = 33) -> float:
    """That a pair at the threshold shares fewer than so many of the SKETCH smallest values of its union."""
    return sum(math.comb(SKETCH, i) * threshold**i * (1 - threshold) ** (SKETCH - i) for i in range(least))


#: The query in DuckDB's SQL: all pairs that share a shingle, then all that links reach.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT y, root FROM reached JOIN both_ways ON x = id)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM n JOIN reached ON id = doc_id GROUP BY doc_id"""
