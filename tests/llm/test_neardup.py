import random

import numpy as np
import pyarrow as pa
import pytest
from tidemill.llm import kernel, neardup
from tidemill.llm.components import components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(docs):
    """doc_id -> (set size, smallest linked id), by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, share, rng, vocabulary):
    return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in words)


def corpus(seed, base, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(base):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 40, 120, 400)))] + passage * (rng.random() < 0.4)
        out += [edited(words, rng.choice((0, 0.002, 0.01, 0.02, 0.04)), rng, vocabulary) for _ in range(rng.choice(copies))]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def test_matches_all_pairs_on_groups_around_the_threshold(spark):
    docs = corpus(1, 60, (1, 2, 5, 12))
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_force(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_group_is_worked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, vocabulary = random.Random(3), [f"v{i}" for i in range(900)]
    words = [rng.choice(vocabulary) for _ in range(150)]
    docs = [(i, edited(words, 0.012, rng, vocabulary)) for i in range(150)]
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_force(docs)


@pytest.mark.parametrize(("list_block", "way"), [(1, "part"), (256, "v")])
def test_strays_of_a_large_group_by_blocks_and_by_lists(spark, monkeypatch, list_block, way):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "LIST_BLOCK", list_block)
    if way == "v":
        monkeypatch.setattr(neardup, "_fewer_by_list", lambda by_block, by_list: by_block.select("part"))
    rng, vocabulary = random.Random(6), [f"v{i}" for i in range(900)]
    docs = []
    for words in ([rng.choice(vocabulary) for _ in range(150)] for _ in range(2)):
        for _ in range(60):  # a chain: each text is an edited one of those before it
            words = edited(words, 0.008, rng, vocabulary).split()
            docs.append((rng.randrange(10**6), " ".join(words)))
    docs = list(dict(docs).items())
    taken = {}
    plain = neardup._stray_links

    def watched(given, rows, key, place, percent):
        taken[key] = rows.where("stray").count()
        return plain(given, rows, key, place, percent)

    monkeypatch.setattr(neardup, "_stray_links", watched)
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_force(docs)
    assert taken[way] > 8


def shared_passages(n, passages=200, seed=9):
    """Texts of three of some passages of 40 words and 30 words of their own; every tenth of the first thousand is an edited copy of the one before."""
    rng = random.Random(seed)
    lines = [" ".join(f"p{k}w{rng.randrange(10**6)}" for _ in range(40)) for k in range(passages)]
    out = []
    for i in range(n):
        text = " ".join([*rng.sample(lines, 3), *(f"own{rng.randrange(10**9)}" for _ in range(30))])
        out.append((i, out[-1][1].replace("own", "its", 2) if i % 10 == 9 and i < 1000 else text))
    return out


def test_documents_that_share_passages_are_dealt_as_often_in_a_larger_table(spark, monkeypatch):
    dealt = []
    with_sets, plain = neardup._with_sets, neardup._dealt
    monkeypatch.setattr(neardup, "_with_sets", lambda given, rows: dealt.append(rows.count()) or with_sets(given, rows))
    monkeypatch.setattr(neardup, "_dealt", lambda rows, key, place, *more: (x := plain(rows, key, place, *more), dealt.append(x.count() if "earlier" in more else 0))[0])
    each = {}
    for n in (2_000, 8_000):
        dealt.clear()
        docs = shared_passages(n)
        found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        each[n] = sum(dealt) / n
        if n == 2_000:
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_force(docs)
        assert sum(not r.kept for r in found) == 100
    print("dealt", each)
    assert each[8_000] <= 1.5 * each[2_000]


def test_texts_of_one_id_are_compared_one_by_one(spark, monkeypatch):
    """A third of all rows under one id, each with a text of its own: they are one document, and no group gets them all."""
    largest = spark.sparkContext.accumulator(0)
    plain = neardup._link_block

    def watched(percent):
        link = plain(percent)

        def run(table):
            if table.num_rows > 200:
                raise ValueError(f"{table.num_rows} rows in a group")
            largest.add(1)
            return link(table)

        return run

    monkeypatch.setattr(neardup, "_link_block", watched)
    rng = random.Random(10)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    hot = [(500, text()) for _ in range(400)]
    rest = [(i, text()) for i in range(400)]
    near = [(1000 + k, hot[k][1] + " end") for k in range(3)] + [(100, hot[7][1] + " end"), (2000, rest[200][1] + " end")]
    found = neardup.near_duplicates(spark.createDataFrame(hot + rest + near, "doc_id long, text string").repartition(4)).collect()
    expected = {i: i for i, _ in rest} | {500: 100, 1000: 100, 1001: 100, 1002: 100, 2000: 200}
    assert len(found) == 805 and {r.doc_id: r.component_id for r in found} == expected and largest.value


def test_blocks_are_bounded_by_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2000)
    seen = spark.sparkContext.accumulator(0)
    plain = neardup._link_block

    def watched(percent):
        def run(table):
            if sum(len(x.as_buffer()) for x in table["shingles"]) > 3 * 8 * 2000:
                raise ValueError("a block is too large")
            seen.add(1)
            return plain(percent)(table)

        return run

    monkeypatch.setattr(neardup, "_link_block", watched)
    words = [f"x{i}" for i in range(400)]
    docs = [(i, " ".join([*words, f"end{i}"])) for i in range(60)]
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0} and seen.value >= 12


def test_odd_rows(spark, odd_docs, no_docs):
    found = sorted(neardup.near_duplicates(odd_docs).collect(), key=lambda r: (r.doc_id or 0, r.n_shingles))
    assert len(found) == 13
    by = {r.doc_id: r for r in found}
    assert by[None].component_id is None and by[None].kept
    assert by[5].component_id == 1 and not by[5].kept and by[1].kept
    assert by[7].component_id == 6 and by[9].component_id == 8
    assert [by[i].n_shingles for i in (2, 3, 4)] == [0, 0, 0] and all(by[i].component_id == i for i in (2, 3, 4))
    assert neardup.near_duplicates(no_docs).count() == 0


def test_dropping_keeps_one_of_each_group_and_all_columns(spark, odd_docs):
    left = neardup.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in left.select("doc_id").collect()) == [0, 1, 2, 3, 4, 6, 8, 10, 11]


def test_dropping_from_an_empty_table(no_docs):
    left = neardup.drop_near_duplicates(no_docs)
    assert left.columns == no_docs.columns and left.count() == 0


def test_hashes_do_not_depend_on_batches(monkeypatch):
    texts = ["a b c d e f", "", None, "  B c", "b C", "x" * 50 + " y " * 40, "é a", "z"]
    whole = kernel.words(pa.array(texts))
    counts = kernel.word_counts(pa.array(texts))
    assert counts.tolist() == np.diff(whole[-1]).tolist() == [len((t or "").encode().split()) for t in texts]
    monkeypatch.setattr(kernel, "CHUNK", 16)
    parts = kernel.words(pa.array(["skip", *texts])[1:])
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert (kernel.word_counts(pa.array(["skip", *texts])[1:]) == counts).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 200)] + [(300, 300), (401, 400)]
    found = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 200)} | {400: 400, 401: 400}


def test_sketch_misses_next_to_nothing():
    assert neardup.chance_of_missing() < 1e-9


def components_at(docs, percent):
    """The smallest linked id of each document, by comparing all pairs."""
    sets, root = {i: shingle_set(t) for i, t in docs}, {i: i for i, _ in docs}
    for i in sets:
        for j in sets:
            if j < i and sets[j] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_matches_all_pairs_at_80_percent(spark):
    docs = corpus(4, 50, (1, 2, 5, 12))
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), percent=80).collect()
    expected = components_at(docs, 80)
    assert {r.doc_id: r.component_id for r in found} == expected != components_at(docs, 85)


def test_sketch_misses_next_to_nothing_at_any_threshold():
    assert neardup.shared(85) == 33
    assert all(neardup.chance_of_missing(p / 100, neardup.shared(p)) < 1e-9 for p in range(neardup.LEAST_PERCENT, 101))


def test_repeats_of_a_row_go_to_no_group(spark, monkeypatch):
    plain = neardup._link_block

    def watched(percent):
        link = plain(percent)

        def run(table):
            if table.select(["node", "shingles"]).to_pandas().duplicated().any():
                raise ValueError(f"{table.num_rows} rows in a group")
            return link(table)

        return run

    monkeypatch.setattr(neardup, "_link_block", watched)
    words = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(words))] * 300 + [(2, " ".join([*words, "more"])), (2, "another text of the same id"), (3, "alone")]
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert len(found) == 303 and {(r.doc_id, r.component_id) for r in found if r.n_shingles > 50} == {(1, 1), (2, 1)}
