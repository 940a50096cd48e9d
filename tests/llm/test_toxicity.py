import random

import numpy as np
import pyarrow as pa
from tidemill.llm import toxicity as tox


def test_factorization_machine_learns_a_pair_that_weights_cannot():
    rng = np.random.default_rng(0)
    rows, terms, y = [], [], []
    for i in range(2000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        for term, there in ((0, insult), (1, group), (2 + int(rng.integers(5)), True)):
            if there:
                rows.append(i)
                terms.append(term)
        y.append(float(insult and group))
    bias, w, v = tox.fit(np.array(rows), np.array(terms), np.array(y), 7, rounds=400)
    score = lambda *t: 1 / (1 + np.exp(-tox.raw_scores(np.zeros(len(t), int), np.array(t, int), 1, bias, w, v)[0][0]))
    assert score(0, 1, 2) > 0.9 and score(0, 2) < 0.1 and score(1, 2) < 0.1
    assert v[0] @ v[1] > 1  # the pair carries it


def test_scores_on_held_out_rows(spark):
    rng = random.Random(1)
    words, bad = [f"w{i}" for i in range(300)], ["zork", "blarg", "Vexels", "vexing"]
    rows, labels = [], []
    for i in range(800):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))] + ([rng.choice(bad)] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    found = tox.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) / len(held) > 0.97


def test_held_out_labels_and_other_columns_change_nothing(spark, odd_docs):
    labels = [(i, i % 2) for i in range(12)]
    import zlib

    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, two = (tox.toxicity(odd_docs, spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", "score").collect() for x in (labels, flipped))
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    found = tox.toxicity(odd_docs, labels).collect()
    assert len(found) == 13 and all(0 <= r.score <= 1 for r in found) and not [r for r in found if r.doc_id is None][0].held_out
    empty = [r.score for r in found if r.doc_id in (2, 3, 4)]
    assert len(set(empty)) == 1
    assert {r.predicted for r in tox.toxicity(odd_docs, labels.where("false")).collect()} == {0}
    assert tox.toxicity(no_docs, labels).count() == 0
    assert tox.drop_toxic(odd_docs, labels.where("false")).columns == odd_docs.columns


def test_terms_fold_case_and_drop_marks():
    known = tox.Vocabulary(tox.document_terms(pa.array(["Élan vital"]))[1])
    rows, terms = known.find(pa.array(["élan*** VITAL!!", None, ""]))
    assert set(rows) == {0} and len(terms) == len(known.terms)


def test_repeats_of_an_id_train_once(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(200):
        rows.append((i, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(5)) + (" zork" if i % 3 == 0 else "")))
        labels.append((i, int(i % 3 == 0)))
    labels, schema = spark.createDataFrame(labels, "id long, y int"), "id long, text string"
    one = tox.train(spark.createDataFrame(rows, schema), labels)
    two = tox.train(spark.createDataFrame(rows + [rows[1]] * 500 + [(1, "~ a later text with zork")] * 500, schema), labels)
    assert len(one[0]) and all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_terms_that_are_harmless_alone_reach_the_model(spark):
    """The label is an insult without a group's name, or the name without the insult: neither word alone goes with it."""
    rng = random.Random(3)
    words, rows, labels = [f"word{i}s" for i in range(500)], [], []
    for i in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(words) for _ in range(rng.randrange(10, 40))] + ["scumbag"] * insult + ["minority"] * group
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(insult != group)))
    found = tox.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 700 and sum(r.predicted == labels[r.doc_id][1] for r in held) / len(held) > 0.95


def test_scores_are_the_sums_over_all_pairs():
    rng = np.random.default_rng(5)
    bias, w, v = np.array([0.3]), rng.normal(size=30), rng.normal(size=(30, tox.FACTORS))
    lists = [sorted(rng.choice(30, size=k, replace=False).tolist()) for k in (0, 1, 2, 7, 30)]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    found = tox.raw_scores(rows, np.array(sum(lists, []), int), len(lists), bias, w, v)[0]
    for got, terms in zip(found, lists, strict=True):
        n, pairs = max(1, len(terms)), [(i, j) for i in terms for j in terms if i < j]
        assert abs(got - (0.3 + sum(w[i] for i in terms) / n**0.5 + sum(v[i] @ v[j] for i, j in pairs) / n)) < 1e-9


def test_dropping_from_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, toxic int")
    kept, scored = tox.drop_toxic(odd_docs, labels), tox.toxicity(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == scored.where("predicted = 0").count()
    assert tox.drop_toxic(no_docs, labels).count() == 0 and tox.drop_toxic(no_docs, labels).columns == no_docs.columns


def test_settings_are_compared_without_the_held_out_fold(spark):
    import zlib

    rng = random.Random(6)
    folds = {i: zlib.crc32(str(i).encode()) % 5 for i in range(1500)}
    docs = spark.createDataFrame([(i, " ".join(rng.choice("one two three four five six".split()) for _ in range(9)) + " zork" * (i % 4 == 0)) for i in folds] + [(None, "zork")], "doc_id long, text string")
    labels = lambda wrong: spark.createDataFrame([(i, int((i % 4 == 0) != (f in wrong))) for i, f in folds.items()] + [(1, None), (None, 1)], "doc_id long, toxic int")
    inner = tox.validate(docs, labels(()))
    assert inner["rows"] == sum(f == tox.INNER for f in folds.values()) and inner["right"] > 0.99 and inner["found"] > 0.99 and inner["wrongly"] < 0.01 and inner["log_loss"] < 0.1
    assert tox.validate(docs, labels((tox.HELD_OUT,))) == inner  # labels of the held-out fold play no part
    assert tox.validate(docs, labels((tox.INNER,)))["right"] < 0.01  # nor does the model learn from the fold it is judged on
    held = tox.validate(docs, labels(()), on=tox.HELD_OUT)
    assert held["rows"] == sum(f == tox.HELD_OUT for f in folds.values()) and held["right"] > 0.99
    assert tox.validate(docs, labels(()).where("false")) == {"rows": 0, "right": 0, "found": 0, "wrongly": 0, "log_loss": 0}
