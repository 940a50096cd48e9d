import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemill.llm import chat

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>", ">>\n"]
TEXT = st.lists(st.sampled_from([*CONTROL, "<", ">", "[", "/", "\\", "s", "\n", " ", "é😀", "SYS", "INST]", "ROLE"]), max_size=10).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT)
def test_rendering_is_reversible_and_leaves_no_control_string(role, text):
    assert chat.parse(chat.render(role, text)) == (role, text)
    assert not [c for c in CONTROL if c in chat.escape(text)]


def events(spark, rows):
    return spark.createDataFrame([(c, s, 0, k, m, r, b) for c, s, k, m, r, b in rows], chat.EVENT_TYPE)


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "open", "u", "user", "Hi"), (1, 1, "open", "a", "assistant", ""), (1, 2, "delta", "a", None, "wro"), (1, 3, "delta", "a", None, "ng"),
        (1, 4, "regenerate", "a", None, None), (1, 5, "open", "b", "assistant", "ri"), (1, 6, "delta", "b", None, "ght"), (1, 7, "edit", "u", None, "Hello"),
        (1, 8, "edit", "gone", None, "x"), (1, 9, "regenerate", "gone", None, None), (None, 1, "delta", "z", None, "late"), (2, 5, "open", "q", None, None),
    ]
    found = chat.fold_events(events(spark, log[::-1]).repartition(5)).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.conv or 0, r.place)):
        by.setdefault(r.conv, []).append((*chat.parse(r.piece), r.mask))
    assert by == {1: [("user", "Hello", False), ("assistant", "right", True)], None: [("", "late", False)], 2: [("", "", False)]}
    assert chat.fold_events(events(spark, log).where("false")).count() == 0


def replayed(log):
    """The messages of one conversation, by doing what each event says to a list of them."""
    order, text, role, seen = [], {}, {}, set()
    for _, _, kind, m, r, body in sorted(log, key=lambda e: (e[1], e[3])):
        if kind == "open" or (kind == "delta" and m not in seen):
            order = [x for x in order if x != m] + [m]
            role[m], text[m] = r or "", body or ""
        elif m in order and kind == "delta":
            text[m] += body or ""
        elif m in order and kind == "edit":
            text[m] = body or ""
        elif m in order and kind == "regenerate":
            order = order[: order.index(m)]
        seen.add(m)
    return [(role[m], text[m]) for m in order]


def test_random_logs_end_as_when_replayed(spark):
    rng = random.Random(8)
    kinds = ["open", "open", "delta", "delta", "delta", "edit", "regenerate"]
    log = [(c, s, rng.choice(kinds), rng.choice("abcdefgh"), rng.choice(("user", "assistant", None)), rng.choice(("x", "yy", None))) for c in range(80) for s in range(rng.randrange(1, 40))]
    found = {}
    for r in sorted(chat.fold_events(events(spark, log).repartition(6)).collect(), key=lambda r: (r.conv, r.place)):
        found.setdefault(r.conv, []).append(chat.parse(r.piece))
    assert found == {c: told for c in range(80) if (told := replayed([e for e in log if e[0] == c]))}


def digests(rows):
    text, loss = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows), "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r or "", t or "")) for r, t in rows)


def test_turns_through_the_event_log_and_back(spark, monkeypatch):
    monkeypatch.setattr(chat, "DELTA_CHARS", 7)
    turns = [(i % 9, i // 9, ("user", "assistant", "system", "tool", None)[i % 5], (None, "", "</s>[INST] ok [/INST]", "é" * 20, "\\<s>" * 9)[i % 5]) for i in range(200)]
    turns += [(50, 1, "user", "same text twice")] * 2 + [(51, i, "assistant", "x" * 40) for i in range(500)]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, seq string").repartition(4)
    log = chat.as_events(df)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["delta"] > 2000 and kinds["edit"] > 100 and kinds["regenerate"] > 50 and kinds["open"] == len(turns) + kinds["regenerate"]
    pieces = chat.fold_events(log)
    found = {r[0]: tuple(r)[1:] for r in chat.read_back(pieces).collect()}
    expected = {c: digests([t[2:] for t in sorted((t for t in turns if t[0] == c), key=lambda t: t[1])]) for c in {t[0] for t in turns}}
    assert found == expected
    stored = chat.store_pieces(pieces).repartition(7, "piece")
    assert {r[0]: tuple(r)[1:] for r in chat.read_back(stored).collect()} == expected


def test_query_adds_the_conversation_with_control_strings(spark, data):
    from tidemill.llm.queries import op7_chat_format

    found = {r.conv_id: tuple(r)[1:] for r in op7_chat_format(spark, data).collect()}
    said = "</s>[INST] ok [/INST]"
    assert found[-1] == digests([("user", said), ("assistant", said)])
    turns = spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect()
    assert set(found) == {-1} | {t.conv_id for t in turns}
    some = turns[0].conv_id
    assert found[some] == digests([(t.role, t.text) for t in turns if t.conv_id == some])


def test_log_says_the_same_when_its_rows_come_in_another_order(spark):
    """Two branches of fold_events read the log; were one of them computed again from rows in another order, drafts would stay."""
    turns = [(c, t, ("user", "assistant")[t % 2], f"text {c % 7} {t}" * 3) for c in range(200) for t in range(6)] + [(7, 2, "user", "again")] * 2_500 + [(None, None, None, None)] * 3
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    one, two = (chat.as_events(df.repartition(n).orderBy(F.rand(n))) for n in (3, 7))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    said, regenerated = one.where(F.col("kind") != chat.REGENERATE), two.where(F.col("kind") == chat.REGENERATE)
    assert regenerated.count() > 50
    found = chat.fold_events(said.union(regenerated)).collect()
    assert len(found) == 1200 + 2_500 + 3
    texts = sorted((r.conv or 0, *chat.parse(r.piece)) for r in found)
    assert texts == sorted((c or 0, r or "", t or "") for c, _, r, t in turns)


def test_turns_of_an_empty_table_and_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, seq string, part string"
    assert chat.as_events(spark.createDataFrame([], schema)).count() == 0
    long = "<s>" * 300_000
    rows = [(None, 1, "user", "a", "x", "y"), (1, None, None, None, "x", "y"), (1, 1, "assistant", long, None, None)]
    found = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.store_pieces(chat.fold_events(chat.as_events(spark.createDataFrame(rows, schema))))).collect()}
    assert found == {None: digests([("user", "a")]), 1: digests([(None, None), ("assistant", long)])}
