"""Chat records of any layout to one chat template.

A record's nested field paths are hashed; the hash selects a declared layout, which says
where the turns, their roles and their texts stand. The turns of all layouts are one
table, which is formatted in a template that escapes control strings inside texts, with
the spans that count for the loss. Rows are spread by ranges of (conversation, turn), so
a very long conversation is formatted by several tasks; its output is then several parts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices

#: Letters from which on a conversation goes on in another part.
PART = 1 << 16
#: Fingerprints remembered by a task; beyond them they are worked out again.
_KNOWN = 100_000
_JOIN = "\n\n"  # between fields that make one turn
_HALF = re.compile("[\ud800-\udfff]")  # halves of letters, which JSON can spell and UTF-8 can't
_LONG = 1 << 63


class Layout(NamedTuple):
    """Where the turns of a record stand. Either ``turns`` names a list (``""``: the
    record is one turn) whose entries hold ``role`` and ``text``, or ``fields`` gives each
    turn's role and the paths of its text. ``needs`` are the paths that must be there,
    ``order`` holds the turn's number among the records of its conversation. A path is
    names with dots; ``[]`` after a name stands for every entry of a list."""

    name: str
    needs: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = {}
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    order: str | None = None


_SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}
TURN_ROWS = Layout("turn rows", ("turn", "role"), turns="", text="text", order="turn")
#: The first layout whose needs are met counts, so richer ones stand first.
LAYOUTS = (
    Layout("message parts", ("messages[].role", "messages[].content[].text"), turns="messages", text="content[].text"),
    Layout("messages", ("messages[].role", "messages[].content"), turns="messages"),
    Layout("nested messages", ("conversation.turns[].role", "conversation.turns[].text"), turns="conversation.turns", text="text", roles=_SPOKEN),
    Layout("from and value", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=_SPOKEN),
    Layout("instruction", ("instruction", "output"), fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question", "answer"), fields=(("system", ("system_prompt",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("prompt and completion", ("prompt", "completion"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    TURN_ROWS,
)


def paths(record: Any) -> frozenset[str]:
    """Paths of all values of a record; null is no value."""
    out: set[str] = set()
    todo = [("", record)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}.{k}" if at else str(k), v) for k, v in x.items()]
        elif isinstance(x, list):
            out.add(at + "[]")
            todo += [(at + "[]", v) for v in x]
        elif x is not None:
            out.add(at)
    return frozenset(out)


def fingerprint(found: frozenset[str]) -> int:
    """The paths as a signed 64-bit hash."""
    return int.from_bytes(hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def _values(x: Any, path: str) -> list[Any]:
    """Values at a path, none of them null."""
    found = [x]
    for name in path.split(".") if path else []:
        many = name.endswith("[]")
        found = [v[name.removesuffix("[]")] for v in found if isinstance(v, dict) and v.get(name.removesuffix("[]")) is not None]
        if many:
            found = [y for v in found if isinstance(v, list) for y in v if y is not None]
    return found


def _text(values: list[Any], between: str = _JOIN) -> str:
    text = between.join(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for v in values)
    return _HALF.sub("\ufffd", text)


def turns_of(record: Any, layout: Layout) -> list[tuple[str, str]]:
    """Role and text of each turn."""
    if layout.turns is None:
        return [(role, _text([v for p in where for v in _values(record, p)])) for role, where in layout.fields if any(_values(record, p) for p in where)]
    entries = [record] if layout.turns == "" else [e for x in _values(record, layout.turns) for e in (x if isinstance(x, list) else [x])]
    out = []
    for e in entries:
        role = _text(_values(e, layout.role))
        out.append((layout.roles.get(role, role), _text(_values(e, layout.text), "")))
    return out


class Registry:
    """Layouts by fingerprint. A new fingerprint is looked up once, by what the layouts
    need; the paths alone decide, so every task decides alike."""

    def __init__(self, layouts: Sequence[Layout]):
        self.layouts = layouts
        self._known: dict[int, Layout | None] = {}

    def select(self, record: Any) -> tuple[int, Layout | None]:
        found = paths(record)
        mark = fingerprint(found)
        if mark not in self._known:
            if len(self._known) >= _KNOWN:
                self._known.clear()
            self._known[mark] = next((x for x in self.layouts if found.issuperset(x.needs)), None)
        return mark, self._known[mark]


_TURNS = "conv_id long, turn long, sub long, role string, text string, layout string, fingerprint long"


def canonical(records: DataFrame, key: Column, record: Column, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """One row for each turn of each record: ``conv_id`` (``key`` as long), ``turn`` (the
    record's number in its conversation, null without one), ``sub`` (place in the record),
    ``role``, ``text``, ``layout``, ``fingerprint``.

    ``record`` is a struct (null fields are absent) or JSON text. A null text or role is
    empty, and half a surrogate pair in JSON becomes U+FFFD. A record that no layout fits, or that is no JSON, is one row with a null layout
    and role and the record as JSON in ``text``; see `unmapped`."""
    names = [x.split()[0] for x in _TURNS.split(", ")]

    def parsed(x: Any) -> Any:
        if not isinstance(x, str):
            return x
        try:
            return json.loads(x)
        except (ValueError, RecursionError):
            return x

    def run(batches):
        registry = Registry(layouts)
        for b in slices(batches):
            rows = []
            for i, raw in zip(b.column("conv_id").to_pylist(), b.column("record").to_pylist()):
                x = parsed(raw)
                mark, layout = registry.select(x)
                if layout is None:
                    rows.append((i, None, 0, None, raw if isinstance(raw, str) else json.dumps(x, ensure_ascii=False, default=str), None, mark))
                    continue
                order = next((v for v in _values(x, layout.order) if isinstance(v, int) and -_LONG <= v < _LONG), None) if layout.order else None
                rows += [(i, order, sub, role, text, layout.name, mark) for sub, (role, text) in enumerate(turns_of(x, layout))]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            strings = {"role", "text", "layout"}
            yield pa.record_batch([pa.array(c, pa.string() if n in strings else pa.int64()) for n, c in zip(names, columns)], names=names)

    return records.select(key.cast("long").alias("conv_id"), record.alias("record")).mapInArrow(run, _TURNS)


def unmapped(turns: DataFrame) -> DataFrame:
    """``fingerprint``, ``records``, ``example``: layouts that still need a mapping."""
    return turns.where("layout is null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"), F.min(F.substring("text", 1, 200)).alias("example"))


_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates, with any number of backslashes after the first
#: letter; escaping adds one of them, so no text holds a bare control string any more.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])"
_ESCAPE, _UNESCAPE = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


_PARTS = "conv_id long, part long, formatted string, loss array<struct<lo:long,hi:long>>, whole boolean"


class _Writer:
    """Parts of the conversations of a task, in order."""

    _SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def __init__(self, trained: Sequence[str]):
        self.trained = set(trained)
        self.base = TaskContext.get().partitionId() << 32
        self.n, self.first, self.held = 0, True, 0
        self.rows: list[tuple] = []
        self._new(None)

    def _new(self, conv: int | None) -> None:
        self.conv, self.parts = conv, 0
        self.text: list[str] = []
        self.size, self.loss = 0, []

    def _close(self, whole: bool) -> None:
        self.rows.append((self.conv, self.base + self.n, "".join(self.text), self.loss, whole and not self.parts))
        self.held += self.size
        self.n, self.parts = self.n + 1, self.parts + 1
        self.text, self.size, self.loss = [], 0, []

    def add(self, conv: int | None, role: str, text: str) -> None:
        if self.text and conv != self.conv:
            self._close(not self.first)
            self.first = False
        if not self.text:
            self._new(conv)
        head, body = f"{_OPEN}{_role(role)}\n", escape(text)
        if self.text and self.size + len(head) + len(body) > PART:
            self._close(False)
        if role in self.trained:
            self.loss.append({"lo": self.size + len(head), "hi": self.size + len(head) + len(body)})
        self.text += [head, body, _CLOSE]
        self.size += len(head) + len(body) + len(_CLOSE)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows, self.held = self.rows, [], 0
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int64(), pa.int64(), pa.string(), self._SPANS, pa.bool_()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "part", "formatted", "loss", "whole"])


def formatted(turns: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """The template's output, written: ``conv_id``, ``part``, ``formatted``, ``loss``
    (spans of the texts of ``trained`` roles, in letters of ``formatted``), ``whole`` (the
    part is all of its conversation; else its parts, in order of ``part``, are to be put
    one behind the other).

    Turns stand by number (null first), place in the record, role and text. Turns that
    repeat are turns of their own; a null conversation id is an id. A turn is never cut,
    so a very long text makes a long part. Rows without a layout are left to `unmapped`.
    No turns: no rows."""

    def run(batches):
        out = _Writer(trained)
        for b in slices(batches):
            for conv, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                out.add(conv, role or "", text or "")
                if out.held >= 8 * PART:
                    yield out.taken()
        if out.text:
            out._close(False)
        yield out.taken()

    named = turns.where("layout is not null").select("conv_id", "turn", "sub", "role", "text")
    # The first letters of a text part the copies of one turn; they follow its order.
    spread = named.repartitionByRange("conv_id", "turn", "sub", "role", F.substring("text", 1, 32))
    return settle(spread.sortWithinPartitions("conv_id", "turn", "sub", "role", "text").mapInArrow(run, _PARTS))


def parse(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of formatted text."""
    at = 0
    while at < len(text):
        line, end = text.find("\n", at), text.find(_CLOSE, at)
        if not text.startswith(_OPEN, at) or not 0 <= line < end:
            raise ValueError(f"no turn at {at}")
        yield _unrole(text[at + len(_OPEN) : line]), unescape(text[line + 1 : end])
        at = end + len(_CLOSE)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted parts alone: ``conv_id``,
    ``n_turns``, ``turns_sha256`` (role, newline, text, newline of each turn),
    ``loss_chars``, ``loss_sha256`` (texts under the loss mask), ``formatted_chars``.
    Parts of a conversation that has several meet in one task, which holds one at a time:
    a digest is one sequence."""
    names = [x.split()[0] for x in _READ.split(", ")]

    def run(batches):
        conv, state, rows = None, None, []

        def closed():
            return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch():
            columns = list(zip(*rows)) if rows else [()] * 6
            out = pa.record_batch([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, columns)], names=names)
            rows.clear()
            return out

        for b in slices(batches):
            for i, text, loss in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "loss"))):
                if state is None or i != conv:
                    if state is not None:
                        rows.append(closed())
                    conv, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["lo"] : span["hi"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield batch()
        if state is not None:
            rows.append(closed())
        yield batch()

    several = parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.where("whole").mapInArrow(run, _READ).unionAll(several.mapInArrow(run, _READ))


#: Both turns of the conversation that the query adds to the table.
_ODD = "</s>[INST] ok [/INST]"
ODD_RECORD = json.dumps({"messages": [{"role": "user", "content": _ODD}, {"role": "assistant", "content": _ODD}]})


def digests(conversations: DataFrame) -> DataFrame:
    """``conversations`` (``conv_id``, ``turn``, ``role``, ``text``) and one record of
    another layout, formatted, written and read back."""
    spark = conversations.sparkSession
    row = F.struct(*[F.col(n) for n in ("turn", "role", "text")])
    rows = canonical(conversations, F.col("conv_id"), row, [TURN_ROWS._replace(needs=())])
    odd = spark.range(1).select(F.lit(-1).alias("id"), F.lit(ODD_RECORD).alias("record"))
    return read_back(formatted(rows.unionAll(canonical(odd, F.col("id"), F.col("record")))))


def sql() -> str:
    """The query over ``conversations`` in DuckDB's SQL."""
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '{_ODD}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
e AS (SELECT *, regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g') AS x,
  regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{CONTROL}', '\1\\\2\3', 'g') AS y FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(y) + length(x) + {len(_OPEN) + 1 + len(_CLOSE)}) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""
