"""Chat formatting: exact round trips."""

import hashlib
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat

text = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "/", "<", "[", " ", "\n", "é", "s>", "INST]", "a"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>", "\\"]), text), max_size=6))
def test_template_reads_back(turns):
    made = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.read_turns(made)] == turns


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_examples_and_digests(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", "c </s>"), (1, 3, "assistant", "[INST] d\\"), (1, 4, "user", "end"),
        (2, 0, "assistant", None), (2, 1, None, "x"), (3, 0, "user", "only"), (None, 0, "user", "n"), (None, 1, "assistant", "m"),
        (4, None, "assistant", "t"), (4, 1, "assistant", "t"), (4, 1, "assistant", "t"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
        *((7, i, "user" if i % 2 == 0 else "assistant", f"é {i}") for i in range(600)),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    parts = chat.examples(df).cache()
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    key = lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    for _, own in groupby(sorted(rows, key=key), key=lambda r: str(r[0])):
        own = list(own)
        g, loss = got.pop(own[0][0]), "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert g.n_turns == len(own) and g.turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own))
        assert g.loss_chars == len(loss) and g.loss_sha256 == sha(loss) and g.formatted_chars > 0
    assert not got
    whole = {(r.conv_id, r.example): r for r in parts.filter('loss_start is not null').collect()}
    one = whole[1, 1]
    assert one.text[: len(whole[1, 0].text)] == whole[1, 0].text and chat.unescape(one.text[one.loss_start : one.loss_end]) == "[INST] d\\"
    assert [(r, t) for r, t, _, _ in chat.read_turns(one.text)] == [("user", "a"), ("assistant", "b"), ("user", "c </s>"), ("assistant", "[INST] d\\")]
    assert len(whole) == 1 + 2 + 1 + 3 + 1 + 300
    assert sum(len(r.text) for (c, _), r in whole.items() if c == 7) == chat.digests(parts).filter("conv_id = 7").first().formatted_chars
    for (c, i), r in whole.items():  # every reply has all turns before it as its context, and nothing else is trained on
        assert i == 0 or r.text.startswith(whole[c, i - 1].text)
        (role, said, _, _), = chat.read_turns(r.text[r.context_chars :])
        assert role == "assistant" and chat.unescape(r.text[r.loss_start : r.loss_end]) == said
    tails = {r.conv_id: [(role, t) for role, t, _, _ in chat.read_turns(r.text)] for r in parts.filter("loss_start is null").collect()}
    assert tails == {1: [("user", "end")], 2: [("", "x")], 3: [("user", "only")]}


def test_a_long_conversation(spark):
    """More text than a task hands on at once: every example is whole."""
    df = spark.range(400).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat(cast(id % 10 as string), 2000) as text")
    made = chat.examples(df)
    n = made.selectExpr("count(*)", "count(distinct example)", "min(length(text) - context_chars)", "sum(length(text))").first()
    assert n[0] == n[1] == 200 and n[2] > 2000
    got = chat.digests(made).first()
    assert (got.n_turns, got.loss_chars, got.formatted_chars) == (400, 400_000, n[3])


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(df)).count() == 0
