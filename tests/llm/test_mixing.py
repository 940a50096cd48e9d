import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tidemill.llm.mixing import fit_budget, knapsack, mix_sources, source_targets


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(1, 60))
def test_knapsack_is_the_best_of_all_choices(counts, budget):
    taken = knapsack(counts, budget)
    assert all(0 < n <= counts[x] for x, n in taken.items())
    sums = [sum(x * n for x, n in zip(counts, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts.values()))]
    assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= budget)


def test_large_budget_is_met_to_the_word():
    rng = random.Random(2)
    counts = {rng.randrange(1, 5000): rng.randrange(1, 2000) for _ in range(300)}
    total = sum(x * n for x, n in counts.items())
    for budget in (0, 1, total // 3, total - 1, total):
        taken = fit_budget(counts, budget)
        assert all(0 <= n <= counts[x] for x, n in taken.items())
        assert budget - sum(x * n for x, n in taken.items()) <= min(counts)


def test_targets_stop_at_three_times_and_reshare():
    assert source_targets({}) == {}
    found = source_targets({"b": 100, None: 50, "a": 1})
    assert found["a"] == 3 and abs(sum(found.values()) - 151) < 1e-9 and abs(found["b"] / found[None] - 2) < 1e-9
    assert source_targets({"a": 0, "b": 10}) == {"a": 0.0, "b": 10.0}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from("abcdefgh")), st.integers(0, 10_000), max_size=9))
def test_targets_are_those_of_one_water_level(sizes):
    """Each source gets its weight times one level, or three times its size if that is less; the level is found by halving."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, itertools.cycle((5, 2, 1))))  # noqa: B905
    level = lambda x: {s: min(3.0 * sizes[s], weight[s] * x) for s in sizes}
    low, high = 0.0, 1e9
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(level(middle).values()) < sum(sizes.values()) else (low, middle)
    expected, found = level(high), source_targets(sizes)
    assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in sizes)


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    found = mix_sources(odd_docs).collect()
    assert len(found) == 13
    texts = odd_docs.select("doc_id", "text", "source").collect()
    sizes = sorted((r.doc_id or 0, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in texts)
    assert sorted((r.doc_id or 0, r["size"]) for r in found) == sizes
    target = source_targets({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in texts if r.source == s) for s in ("a", "b", "c", None)})
    for source in ("a", "b", "c", None):
        own = [r for r in found if r.source == source]
        assert {r.target for r in own} == {target[source]} and {r.source_size for r in own} == {sum(r["size"] for r in own)}
        assert all(r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] if r["size"] else r.taken == 0 for r in own)
    assert mix_sources(no_docs).count() == 0


def test_taken_words_meet_targets_and_reruns_agree(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = mix_sources(docs.repartition(7)).collect(), mix_sources(docs.repartition(3)).collect()
    assert sorted(a) == sorted(b)
    for source in {r.source for r in a}:
        own = [r for r in a if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def best_sum(lengths, budget):
    return max(t for k in range(len(lengths) + 1) for t in map(sum, itertools.combinations(lengths, k)) if t <= budget)


def test_long_texts_fill_the_budget():
    cases = [([100_000, 120_000], 132_000), ([100_000 + 10_000 * k for k in range(10)], 700_000), ([20_000] * 6, 85_000), ([150_000, 130_000, 120_000], 250_000)]
    rng = random.Random(4)
    for n in range(2, 11):
        lengths = [rng.randrange(65_537, 400_000) for _ in range(n)]
        cases += [(lengths, rng.randrange(sum(lengths))) for _ in range(3)]
    for lengths, budget in cases:
        taken = fit_budget({x: lengths.count(x) for x in lengths}, budget)
        assert all(n <= lengths.count(x) for x, n in taken.items())
        assert sum(x * n for x, n in taken.items()) == best_sum(lengths, budget)


def test_shares_do_not_keep_a_small_source_from_its_budget():
    taken = fit_budget({6: 4, 5: 2}, 20)
    assert sum(x * n for x, n in taken.items()) == 18


def test_mix_takes_the_long_text_that_fits(spark):
    rows = [(1, "w " * 100_000, "a"), (2, "w " * 120_000, "a"), (3, "w " * 44_000, "b")]  # 264,000 words; a gets 3 * 44,000 less than all
    found = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1)).collect()}
    assert found[1].target == found[3].target == 132_000
    assert found[1].taken + found[2].taken == 120_000 and found[3].taken == 132_000


def test_a_mix_keeps_the_lengths_of_its_source(spark):
    rng = random.Random(9)
    lengths = {s: [rng.choice((rng.randrange(1, 40), rng.randrange(40, 900), rng.randrange(900, 6000))) for _ in range(400)] for s in "abc"}
    rows = [(f"{s}{i}", "w " * n, s) for s, all_of in lengths.items() for i, n in enumerate(all_of)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    for source, all_of in lengths.items():
        own = [r for r in found if r.source == source]
        times = [r.taken // r["size"] for r in own]
        more = [r["size"] for r, t in zip(own, times, strict=True) if t > min(times)]
        mean = sum(all_of) / len(all_of)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert not more or abs(sum(more) / len(more) - mean) < 0.1 * mean


def test_fit_without_the_whole_knapsack(monkeypatch):
    from tidemill.llm import mixing

    monkeypatch.setattr(mixing, "MOST_WORDS", 5000)
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randrange(900, 9000): rng.randrange(1, 9) for _ in range(20)}
        total = sum(x * n for x, n in counts.items())
        budget = rng.randrange(total)
        taken = fit_budget(counts, budget)
        left = budget - sum(x * n for x, n in taken.items())
        assert left >= 0 and all(0 <= n <= counts[x] for x, n in taken.items())
        assert all(left < x for x, n in counts.items() if n > taken.get(x, 0))
