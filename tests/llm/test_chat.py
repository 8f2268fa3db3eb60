"""Chat formatting: layouts, escapes, and the whole query against plain loops."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import chat

from .conftest import LONG

WEIRD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|> <\\\\s> [\\INST]", "<<|im_start|>", "<|im_end", "", None, "line\nline\r\n\t", "🦆 é", LONG]
PIECES = st.lists(st.sampled_from(["<", "[", "\\", "|im_end|>", "|x|>", "s>", "/s>", "INST]", "/INST]", "\n", "é", "<|im_start|>", "a", "n"]), max_size=12).map("".join)


def brute(rows):
    """Digests of (conv_id, turn, role, text) rows, and of the added conversation."""
    convs = {}
    for i, turn, role, text in [*rows, (-1, 0, "user", WEIRD[0]), (-1, 1, "assistant", WEIRD[0])]:
        convs.setdefault(i, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for i, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        all_ = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        size = sum(len(f"<|im_start|>{chat._role(r)}\n{chat.escape(t)}<|im_end|>\n") for _, _, r, t in turns)
        out.append((i, len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)) for r in df.collect())


@pytest.fixture
def table(spark):
    rows = [(c, t, r, WEIRD[(c + t) % len(WEIRD)]) for c in range(40) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][: 2 + c % 4])]
    rows += [(50, 1, "assistant", ""), (50, 1, "assistant", ""), (50, None, "user", "null turn"), (None, 0, "user", "null id"), (None, None, None, None), (51, 0, None, "no role"), (52, 3, "odd\\role\nname<|im_end|>", "x")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} of a long conversation" * 3) for t in range(3000)]
    return rows, spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int").repartition(6)


def test_whole_query_against_plain_loops(table):
    rows, df = table
    assert rows_of(chat.digests(df)) == brute(rows)


def test_a_long_conversation_comes_in_parts(spark, table, monkeypatch):
    rows, df = table
    turns = chat.canonical(df, F.col("conv_id"), F.struct("turn", "role", "text"), [chat.TURN_ROWS._replace(needs=())])
    parts = chat.formatted(turns).orderBy("part").collect()
    own = [p for p in parts if p.conv_id == 60]
    assert len(own) > 3 and not any(p.whole for p in own)
    want = [(r, x) for i, _, r, x in rows if i == 60]
    assert list(chat.parse("".join(p.formatted for p in own))) == want
    for p in parts:
        said = [x for r, x in chat.parse(p.formatted) if r == "assistant"]
        assert [chat.unescape(p.formatted[s.lo : s.hi]) for s in p.loss] == said
        assert p.formatted.count("<|im_end|>\n") == len(list(chat.parse(p.formatted)))
    assert sum(p.whole for p in parts) > 20


def test_empty_table(spark, table):
    assert rows_of(chat.digests(table[1].limit(0))) == brute([])


@settings(max_examples=500, deadline=None)
@given(PIECES, PIECES, PIECES)
def test_escapes_are_reversible(a, b, role):
    assert chat.unescape(chat.escape(a)) == a
    assert not any(x in chat.escape(a) for x in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "<s>", "<|x|>"))
    body = "".join(f"<|im_start|>{chat._role(role)}\n{chat.escape(x)}<|im_end|>\n" for x in (a, b))
    assert list(chat.parse(body)) == [(role, a), (role, b)]


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}], "prompt": "q", "id": "x"}, "messages", [("user", "q"), ("assistant", "r")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"type": "text", "text": "b"}]}]}, "message parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "system", "value": None}]}, "from and value", [("user", "q"), ("assistant", "r"), ("system", "")]),
    ({"conversation": {"turns": [{"role": "prompter", "text": "q"}, {"role": "tool", "text": {"a": 1}}]}}, "nested messages", [("user", "q"), ("tool", '{"a": 1}')]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": None, "output": "done", "system": "be"}, "instruction", [("system", "be"), ("user", "do"), ("assistant", "done")]),
    ({"question": "q", "context": "c", "answer": 42}, "question", [("user", "c\n\nq"), ("assistant", "42")]),
    ({"prompt": "p", "completion": ""}, "prompt and completion", [("user", "p"), ("assistant", "")]),
    ({"prompt": "p", "response": "r"}, "prompt and response", [("user", "p"), ("assistant", "r")]),
    ({"turn": 3, "role": "user", "text": "t"}, "turn rows", [("user", "t")]),
]


def test_every_layout_is_found_by_its_paths(spark):
    rows = [(i, json.dumps(x)) for i, (x, _, _) in enumerate(RECORDS)]
    odd = [(100, "{}"), (101, "not json"), (102, '{"rejected": "a"}'), (103, '{"rejected": "b"}'), (104, "[1, null]"), (105, None), (106, '{"messages": []}'), (107, '"\\ud800"'), (108, "[" * 100_000)]
    df = spark.createDataFrame(rows + odd, "id long, record string")
    got = {}
    turns = chat.canonical(df, F.col("id"), F.col("record"))
    for r in turns.orderBy("conv_id", "sub").collect():
        got.setdefault(r.conv_id, []).append(r)
    for i, (_, name, want) in enumerate(RECORDS):
        assert [(r.layout, r.role, r.text) for r in got[i]] == [(name, *w) for w in want]
    assert got[9][0].turn == 3
    assert all(len(got[i]) == 1 and got[i][0].layout is None for i, _ in odd)
    left = {r.fingerprint: r.records for r in chat.unmapped(turns).collect()}
    assert left[got[102][0].fingerprint] == 2 and sum(left.values()) == len(odd)
    half = chat.canonical(spark.createDataFrame([(1, '{"prompt": "\\ud800", "response": "r"}')], "id long, record string"), F.col("id"), F.col("record"))
    assert half.collect()[0].text == "�"


def test_fingerprints_depend_on_paths_alone():
    f = lambda x: chat.fingerprint(chat.paths(x))
    assert f({"a": [{"b": 1}, {"c": 2}]}) == f({"a": [{"c": "x"}, {"b": None, "c": 1}, {"b": True}]})
    assert len({f({"a": 1}), f({"b": 1}), f({"a": {"b": 1}}), f({"a": [1]}), f({"a": [{"b": 1}]})}) == 5
