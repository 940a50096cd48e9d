import math
import random
import re

import numpy as np
from tidemill.llm import decontam as d


def random_index(rng, terms=40, segments=70):
    rows = [(t, s, rng.random()) for t in range(terms) for s in range(segments) if rng.random() < 0.2]
    total = {}
    for _, s, w in rows:
        total[s] = total.get(s, 0) + w
    rows = [(t, s, w / total[s]) for t, s, w in rows]
    t, s, w = (np.array(x) for x in zip(*rows, strict=True))
    return d.Index(t.astype(np.uint64), s.astype(np.int64), w), rows


def test_wand_returns_all_segments_above_the_threshold_and_no_others(monkeypatch):
    rng = random.Random(4)
    for block in (2, 5, 32):
        monkeypatch.setattr(d, "BLOCK", block)
        index, rows = random_index(rng)
        for _ in range(60):
            query = sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 25)))
            scores = {}
            for t, s, w in rows:
                if t in [int(index.terms[q]) for q in query]:
                    scores[s] = scores.get(s, 0) + w
            for threshold in (0.2, 0.5, 0.8):
                expected = {s for s, x in scores.items() if x >= threshold}
                assert {s for s, _ in index.retrieve(query, threshold)} == expected


def test_essential_lists_never_turn_a_reachable_passage_away():
    rng = random.Random(8)
    for _ in range(20):
        index, _ = random_index(rng)
        passages = [sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 30))) for _ in range(30)]
        pairs = [(p, t) for p, terms in enumerate(passages) for t in terms if index.essential[t]]
        near = index.within_reach(np.array([p for p, _ in pairs]), np.array([t for _, t in pairs]), d.THRESHOLD)
        assert {p for p, terms in enumerate(passages) if index.retrieve(terms, d.THRESHOLD)} <= set(near.tolist())


def test_question_and_answer_of_one_text():
    assert d.question_answer("What is it? It is blue.") == ("What is it? ", "It is blue.")
    assert d.question_answer("one line\nlast line\n")[1].strip() == "last line"
    assert d.question_answer("only this") == ("only this", "")
    assert d.question_answer("") == ("", "")


def corpus(rng):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)] + ["the", "of", "and"] * 200
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(rng.choice((8, 20, 40, 150)))}? {say(rng.choice((1, 4, 12)))}.") for i in range(60)]
    return say, items


def test_planted_items_are_found_whatever_their_case_and_marks(spark):
    rng = random.Random(6)
    say, items = corpus(rng)
    rows, expected = [], set()
    for i in range(300):
        text = say(rng.choice((0, 5, 60, 700)))
        if i % 3 == 0:
            k, item = items[i % 60]
            told = [item, item.upper(), item.replace(" ", "\n"), item.replace(" ", "*** ")][i % 4]
            text = f"{text} {told} {say(rng.choice((0, 30)))}"
            expected.add((i, k))
        elif i % 3 == 1:  # half an item's question is no item
            text = f"{text} {' '.join(items[i % 60][1].split()[:3])} {say(9)}"
        rows.append((i, text))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = d.contaminated(docs.repartition(4), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench).collect()) == sorted(set(range(300)) - {i for i, _ in expected})


def test_several_indexes_find_the_same(spark, monkeypatch):
    rng = random.Random(7)
    say, items = corpus(rng)
    docs = spark.createDataFrame([(i, f"{say(40)} {items[i % 60][1]} {say(40)}") for i in range(120)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
    monkeypatch.setattr(d, "INDEX_POSTINGS", 500)
    found = d.contaminated(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == whole == {(i, i % 60) for i in range(120)}
    assert "ArrowEvalPython" not in plan(found) and "MapInArrow" not in plan(found)  # each index has gone before the next
    assert d.drop_contaminated(docs, bench).count() == 0
    more = docs.union(spark.createDataFrame([(900, "clean"), (901, None), (902, "")], docs.schema))
    kept = d.drop_contaminated(more, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [900, 901, 902] and "ArrowEvalPython" not in plan(kept)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def plain_search(docs, items):
    """(doc, item) by BM25 over all segments and passages, the threshold and both overlaps, written out."""
    segments, df = [], {}
    for item, text in items:
        w = words(text)
        segments += [(item, w[k : k + d.STEP]) for k in range(0, len(w), d.STEP)]
    for _, s in segments:
        for t in set(s):
            df[t] = df.get(t, 0) + 1
    mean = sum(len(s) for _, s in segments) / len(segments)

    def weight(t, s):
        tf = s.count(t)
        return math.log(1 + (len(segments) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (d.K1 + 1) / (tf + d.K1 * (1 - d.B + d.B * len(s) / mean))

    impacts = [(item, {t: weight(t, s) for t in set(s)}) for item, s in segments]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    known = {}
    for item, text in items:
        q, a = d.question_answer(text)
        known[item] = (shingles(words(q)) or set(words(q)), len(words(q)) >= 5, set(words(a)), len(words(q)) + len(words(a)))
    found = set()
    for doc, text in docs:
        w = words(text)
        for a in range(0, len(w), d.STEP):
            passage = set(w[a : a + 2 * d.STEP])
            for item, terms in impacts:
                if sum(x for t, x in terms.items() if t in passage) >= d.THRESHOLD * sum(terms.values()) - 1e-9:
                    question, long, answer, n = known[item]
                    near = w[max(0, a - n) : a + 2 * d.STEP + n]
                    have = shingles(near) if long else set(near)
                    if len(question & have) >= d.QUESTION * len(question) and len(answer & set(near)) >= d.ANSWER * len(answer):
                        found.add((doc, item))
    return found


def test_finds_what_a_plain_search_finds(spark):
    rng = random.Random(12)
    say, items = corpus(rng)
    docs = []
    for i in range(150):
        text = say(rng.choice((3, 60, 300)))
        for _ in range(rng.choice((0, 1, 2))):  # parts of items, whole and harmed, near the threshold
            w = rng.choice(items)[1].split()
            part = w[: max(1, int(len(w) * rng.choice((0.4, 0.6, 0.8, 1))))] + w[-2:] * (rng.random() < 0.5)
            text += " " + " ".join(x for x in part if rng.random() > rng.choice((0, 0.05, 0.15))) + " " + say(10)
        docs.append((i, text))
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    expected = plain_search(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and 40 < len(expected) < 200


def test_postings_of_many_items_take_little_memory():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(f"t{rng.randrange(50_000)}" for _ in range(4000)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["item", "text"])
    rows = [r for part in d._postings([batch]) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
    assert len({r[:3] for r in rows}) == len(rows) and sum(r[3] for r in rows) == 60 * 4000 and {r[4] for r in rows} == {64, 4000 % 64}
    assert max(part.num_rows for part in d._postings([batch])) < 100_000


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (4, "short"), (None, "short")], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id) for r in d.contaminated(odd_docs, bench).collect())
    assert found == [(0, 1), (1, 1), (1, 1), (5, 1), (6, 4), (7, 4)]
    assert d.contaminated(no_docs, bench).count() == 0 and d.contaminated(odd_docs, bench.where("false")).count() == 0
    kept = d.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [2, 3, 4, 8, 9, 10, 11]


def test_answer_column(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", "omega")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta omega y"), (2, "x alpha beta gamma delta epsilon zeta y")], "doc_id long, text string")
    assert [r.doc_id for r in d.contaminated(docs, bench, answer_col="answer").collect()] == [1]
