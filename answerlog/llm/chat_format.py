"""Chat formatting: conversations as text with the parts that a model is trained on marked.

A ``Template`` says in plain tables what stands around each role's turns, which roles are
learned, and a finite-state machine over roles: from each state the state after each role.
What a state does not list leads to ``broken``, which nothing leaves; turns go on being
emitted there, so no row is lost, and ``state`` tells that the order is wrong.

The text comes as segments in order: a control string, the text, a control string. Texts
that hold a control string get a backslash in front of it (one more, if backslashes are
there already), so a control string without one is always a mark; reading takes the one
backslash away. Marks have a space towards the text, so a backslash at the end of a text
does not touch them.

A conversation is formatted by one task that streams over its sorted turns and holds one
batch. Long conversations are cut into ranges of turns (see ``long_runs``); the state at
the beginning of a range is folded from the transitions of the ranges before it.

Defined results: turns are in ascending order of ``turn``, nulls first, then of role and
text; a null role or text is empty; a role that the template does not name is written
with its name; a null id is a conversation of its own; repeated rows are repeated turns;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlog.llm.long_runs import LongGroups

BROKEN = "broken"
SEGMENTS = "conv_id long, place long, part int, segment string, loss boolean, state string"


@dataclass(frozen=True)
class Template:
    """Marks (before, after) and loss of each role, and the states over roles."""

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True),
    })
    # Any other role: its name stands between the first two marks.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    states: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "instructed", "user": "asked"},
        "instructed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        marks = [mark for before, after, _ in self.roles.values() for mark in (before, after)]
        return [*marks, *self.other]

    def pattern(self) -> str:
        """A control string with the backslashes before it."""
        return r"(\\*)(" + "|".join(re.escape(mark) for mark in self.controls()) + ")"

    def names(self) -> list[str]:
        return [*self.states, BROKEN]

    def after(self, state: str, role: str) -> str:
        return self.states.get(state, {}).get(role, BROKEN)

    def check(self) -> None:
        """Marks must be distinct, and begin and end so that two of them cannot overlap."""
        marks = self.controls()
        inner = {c for mark in marks for c in mark[1:-1]}
        if len(set(marks)) < len(marks) or any("\\" in m or " " in m or m[0] in inner or m[-1] in inner for m in marks):
            raise ValueError("marks must be distinct, without spaces or backslashes, and unable to overlap")


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    return conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"),
    )


def _writer(template: Template, entry: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    marks = re.compile(template.pattern())

    def escaped(text: str) -> str:
        return marks.sub(r"\\\g<0>", text) if "[" in text or "<" in text else text

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, place, state = None, 0, template.start
        for batch in batches:
            ids, places, parts, segments, losses, states = [], [], [], [], [], []
            for conv, range_, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if run != (conv, range_):
                    run = (conv, range_)
                    place, state = entry.get(run, (0, template.start))
                place += 1
                state = template.after(state, role)
                if role in template.roles:
                    before, after, loss = template.roles[role]
                else:
                    before, after, loss = f"{template.other[0]} {escaped(role)} {template.other[1]}", template.other[2], False
                ids += [conv] * 3
                places += [place] * 3
                parts += [0, 1, 2]
                segments += [before + " ", escaped(text), " " + after]
                losses += [False, loss, False]
                states += [state] * 3
            columns = [
                pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(parts, pa.int32()),
                pa.array(segments, pa.string()), pa.array(losses, pa.bool_()), pa.array(states, pa.string()),
            ]
            names = ["conv_id", "place", "part", "segment", "loss", "state"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return write


def _entries(turns: DataFrame, template: Template) -> dict:
    """Count and state before each range of the long conversations: fewer than 64,000."""
    names = template.names()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, count, states = None, 0, names

        def row() -> pa.RecordBatch:
            columns = [pa.array([run[0]], pa.int64()), pa.array([run[1]], pa.int32()), pa.array([count], pa.int64())]
            columns.append(pa.array([states], pa.list_(pa.string())))
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "range", "n", "states"])

        for batch in batches:
            for conv, range_, role in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if run != (conv, range_):
                    if run is not None:
                        yield row()
                    run, count, states = (conv, range_), 0, names
                count += 1
                states = [template.after(state, role) for state in states]
        if run is not None:
            yield row()

    keys = ["conv_id", "range"]
    ordered = turns.select(*keys, "role", "turn").repartition(*keys).sortWithinPartitions(
        *keys, F.asc_nulls_first("turn"), "role"
    )
    found = ordered.mapInArrow(follow, "conv_id long, range int, n long, states array<string>").collect()
    entry, conv, count, state = {}, (), 0, template.start
    for r in sorted(found, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["range"])):
        if conv != (r["conv_id"],):
            conv, count, state = (r["conv_id"],), 0, template.start
        entry[r["conv_id"], r["range"]] = (count, state)
        count += r["n"]
        state = r["states"][names.index(state)]
    return entry


def chat_format(
    conversations: DataFrame, template: Template = Template(), long: LongGroups | None = None,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Segments: ``conv_id``, ``place`` (of the turn, from 1), ``part`` (0 to 2),
    ``segment``, ``loss``, ``state`` (after the turn).

    ``long`` names the long conversations of the table (by ``conv_id`` and ``turn``); it
    is found if not given. In each partition the segments of a conversation, or of a
    range of a long one, are together and in order.
    """
    template.check()
    turns = _turns(conversations, conv_id, turn, role, text)
    long = LongGroups.of(turns, "conv_id", "turn") if long is None else long
    turns = long.ranged(turns, "range")
    entry = _entries(turns.filter(long.holds()), template) if long else {}
    keys = ["conv_id", "range"]
    ordered = turns.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("turn"), "role", "text")
    return ordered.select(*keys, "role", "text").mapInArrow(_writer(template, entry), SEGMENTS)


def read_back(template: Template, formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and start and end of the escaped text, of every turn of formatted text."""
    marks = re.compile(template.pattern())
    roles = {before: role for role, (before, _, _) in template.roles.items()}
    known = [m for m in marks.finditer(formatted) if not m[1]]

    def plain(start: int, end: int) -> str:
        return marks.sub(lambda m: m[0][1:], formatted[start:end])

    at = 0
    while at < len(known):
        mark = known[at][2]
        if mark == template.other[0]:
            role = plain(known[at].end() + 1, known[at + 1].start() - 1)
            at += 1
        else:
            role = roles[mark]
        start, end = known[at].end() + 1, known[at + 1].start() - 1
        yield role, plain(start, end), start, end
        at += 2


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, state string"
)
HELD = 1 << 20


def _reader(template: Template) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests of conversations from their formatted text alone, read every ``HELD``
    characters; the mask is that of the segments."""

    class Read:
        def __init__(self, conv):
            self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.loss_chars = self.chars = self.size = 0
            self.state = template.start
            self.held: list[str] = []
            self.mask: list[tuple[int, int]] = []

        def add(self, segment: str, loss: bool, part: int, state: str) -> None:
            if loss:
                self.mask.append((self.size, self.size + len(segment)))
            self.held.append(segment)
            self.size += len(segment)
            self.state = state
            if part == 2 and self.size > HELD:
                self.read()

        def read(self) -> None:
            mask = iter([*self.mask, (-1, -1)])
            learned = next(mask)
            for role, text, start, end in read_back(template, "".join(self.held)):
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n_turns += 1
                if learned == (start, end):
                    self.loss.update(text.encode())
                    self.loss_chars += len(text)
                    learned = next(mask)
            if learned != (-1, -1):
                raise ValueError("the mask covers something else than one text")
            self.chars += self.size
            self.held, self.mask, self.size = [], [], 0

        def row(self) -> tuple:
            self.read()
            return (
                self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars, self.state,
            )

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [part.split(" ")[0] for part in DIGESTS.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(5))
            for conv, part, segment, loss, state in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Read(conv)
                now.add(segment, loss, part, state)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), kinds)], names)

    return digest


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation from segments in the order of ``chat_format``: counts and
    digests of the turns and of the text under the mask, and the last ``state``.

    Nothing is shuffled. A conversation whose segments are spread must be brought together
    first; its digest is one pass over its text by nature, in a stream of bounded memory.
    """
    return segments.select("conv_id", "part", "segment", "loss", "state").mapInArrow(_reader(template), DIGESTS)


def formatted_digests(conversations: DataFrame, template: Template = Template(), **limits: int) -> DataFrame:
    """``digests`` of all conversations; only those in ranges are shuffled again."""
    long = LongGroups.of(conversations, "conv_id", "turn", **limits)
    none = LongGroups("conv_id", "turn")
    if not long:
        return digests(chat_format(conversations, template, none), template)
    short = digests(chat_format(conversations.filter(~long.holds()), template, none), template)
    spread = chat_format(conversations.filter(long.holds()), template, long)
    order = ["conv_id", "place", "part"]
    whole = spread.repartition("conv_id").sortWithinPartitions(*order)
    return short.unionByName(digests(whole, template))
