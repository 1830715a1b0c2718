"""Fill-in-middle, chat formatting and the prefix trie against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlog.llm import chat_format as chat
from answerlog.llm.chat_format import Template, chat_format, formatted_digests, read_back
from answerlog.llm.fill_in_middle import ByteIndex, Layout, fill_in_middle, restored
from answerlog.llm.long_runs import LongGroups
from answerlog.llm.prefix_trie import Rebuild, SlotTable, prefix_trie
from answerlog.llm.queries import id_remainder

TURNS = "conv_id long, turn long, role string, text string, state string, place int, c long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-middle


def plain_fim(doc_id, text, layout=Layout()):
    text = text or ""
    digest = sha(f"{layout.seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    marks = (layout.prefix, layout.suffix, layout.middle)
    if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - layout.plain_percent:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h[3] % 100 < layout.suffix_first_percent:
        return n, "spm", a, b - a, s + z + p + x + m + y
    return n, "psm", a, b - a, p + x + s + z + m + y


@pytest.mark.parametrize("layout", [Layout(), Layout("<<a>", "b>", "|", 0, 50, 7)])
def test_fill_in_middle_equals_slices(spark, messy, messy_rows, layout):
    rng = random.Random(2)
    extra = ["".join(rng.choice("a<P>SMé漢😀\n ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    extra += ["😀" * 3000 + "x" * 100_000 + "é" * 50_000, "ends in <", "<", "<P", "P>"]
    more = [(1000 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(extra)]
    docs = messy.unionByName(spark.createDataFrame(more, messy.schema))
    made = fill_in_middle(docs.withColumn("fim", F.lit("old")), layout)
    got = made.withColumn("back", restored(F.col("fim.output"), F.col("fim.form"), layout)).collect()
    want = collections.Counter((r[0], *plain_fim(r[0], r[1], layout)) for r in messy_rows + more)
    assert collections.Counter((r.doc_id, *r.fim) for r in got) == want
    assert all(r.back == (r.text or "") for r in got)


def test_fill_in_middle_of_nothing(empty):
    assert fill_in_middle(empty).count() == 0


def test_byte_index_goes_both_ways():
    text = "aé漢😀b" * 9 + "plain"
    index = ByteIndex(np.frombuffer(text.encode(), np.uint8))
    places = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == places.tolist()
    assert index.to_points(places).tolist() == list(range(len(text) + 1))


# Chat formatting


def conversations(seed: int, number: int, most: int, words: list[str]) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(number):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "[ROLE] x", "a\\[TEXT]"])
            if rng.random() < 0.7:
                role = "user" if t % 2 == 0 else "assistant"
            text = rng.choice([None, "", *words, "".join(rng.choice(words) for _ in range(4))])
            rows.append((c, t if rng.random() < 0.95 else rng.choice([None, 0]), role, text, "s", 1, 2))
    rows += [rows[0], rows[0], (None, 0, "user", "nobody", "s", 1, 2), (None, 1, "assistant", "\\", "s", 1, 2)]
    rng.shuffle(rows)
    return rows


PIECES = ["[INST]", "</s>", "<s>", "\\", "\\\\", " ", "[/INST]", "ok", "é\n", "[TEXT]", "[INS", "T]", "<", "😀", "[ROLE]"]


def in_order(rows: list[tuple]) -> dict:
    found = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        found[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in found.items()}


def plain_digests(rows: list[tuple], template: Template = Template()) -> dict:
    found = {}
    for c, turns in in_order(rows).items():
        learned = [text for role, text in turns if role in template.roles and template.roles[role][2]]
        state = template.start
        for role, _ in turns:
            state = template.after(state, role)
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        found[c] = (len(turns), sha(whole), sum(map(len, learned)), sha("".join(learned)), state)
    return found


@pytest.mark.parametrize("limits", [{}, {"least": 3, "share": 100, "ranges": 4}, {"least": 0, "share": 10_000, "ranges": 2}])
def test_formatted_text_is_read_back(spark, limits, monkeypatch):
    monkeypatch.setattr(chat, "HELD", 40)
    rows = conversations(1, 25, 12, PIECES)
    rows += [(500, t, ["user", "assistant"][t % 2], "[INST] " * (t % 3), None, None, None) for t in range(300)]
    got = formatted_digests(spark.createDataFrame(rows, TURNS).repartition(3), **limits).collect()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "state"]
    assert {r.conv_id: tuple(r[name] for name in names) for r in got} == plain_digests(rows)
    assert len(got) == len({r[0] for r in rows})


def test_segments_hold_the_marks_and_the_mask(spark):
    rows = [(1, 0, "user", "a [INST] b\\", "s", 1, 2), (1, 1, "assistant", "\\</s>", "s", 1, 2), (1, 2, "tool", "t", "s", 1, 2)]
    got = chat_format(spark.createDataFrame(rows, TURNS)).orderBy("place", "part").collect()
    assert "".join(r.segment for r in got) == (
        "[INST] a \\[INST] b\\ [/INST]<s> \\\\</s> </s>[ROLE] tool [TEXT] t [/TEXT]"
    )
    assert [r.segment for r in got if r.loss] == ["\\\\</s>"]
    assert [r.state for r in got if r.part == 0] == ["asked", "answered", "broken"]
    whole = "".join(r.segment for r in got)
    assert [x[:2] for x in read_back(Template(), whole)] == [("user", "a [INST] b\\"), ("assistant", "\\</s>"), ("tool", "t")]


def test_formatting_nothing_and_bad_templates(spark):
    assert formatted_digests(spark.createDataFrame([], TURNS)).count() == 0
    with pytest.raises(ValueError):
        chat_format(spark.createDataFrame([], TURNS), Template(other=("a b", "c", "d")))


def test_long_groups_are_ranged(spark):
    rows = [(1, t) for t in range(1000)] + [(2, 5)] * 10 + [(None, t) for t in range(500)]
    df = spark.createDataFrame(rows, "k long, o long")
    long = LongGroups.of(df, "k", "o", least=100, share=10, ranges=8)
    assert set(long.bounds) == {1, None}
    sizes = {(r.k, r.n): r["count"] for r in long.ranged(df, "n").groupBy("k", "n").count().collect()}
    assert len([k for k in sizes if k[0] == 1]) == 8 and max(sizes.values()) < 200 and sizes[2, 0] == 10
    assert not LongGroups.of(df, "k", "o")


# Prefix trie


def plain_trie(rows: list[tuple], borrows: bool) -> collections.Counter:
    own = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if borrows else 0
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:] if borrows else own[c]
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1].encode()) if k else 0
    return collections.Counter(
        (v[0], len(k), members[k[:-1]][0] if k else None, len(v), kids[k], leaves[k], saved[k],
         sha(",".join(str(c) for c in v if len(built[c]) == len(k))))
        for k, v in members.items()
    )


@pytest.mark.parametrize("borrows", [False, True])
@pytest.mark.parametrize(
    "limits",
    [{}, {"limit": 1, "chunk": 2}, {"levels": 6, "limit": 4, "chunk": 1},
     {"levels": 7, "limit": 1, "most": 3, "least": 0, "share": 10_000, "ranges": 4}],
)
def test_trie_equals_brute_force(spark, borrows, limits):
    rows = conversations(3, 40, 9, ["a", "b", "é"])
    rows += [(100 + i, t, "user", "hi" if t < 7 else str(i % 2), None, None, None) for i in range(10) for t in range(9)]
    rows += [(999, t, "user", "hi", None, None, None) for t in range(14)] + [(7, 0, "user", "")[:4] + (None, None, None)]
    rebuild = Rebuild(id_remainder(9), lambda c: c - c % 5) if borrows else Rebuild()
    got = prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3), rebuild, **limits).collect()
    assert collections.Counter(map(tuple, got)) == plain_trie(rows, borrows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie(empty).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x", None, None, None)], TURNS)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "x", None, None, None), (lone, 1, "user", "y", None, None, None)]
    rebuild = Rebuild(id_remainder(9), lambda c: c - c % 5)
    got = prefix_trie(spark.createDataFrame(rows, TURNS), rebuild).collect()
    assert [tuple(r) for r in got] == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]


def test_slots_are_minimal_and_tell_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        table = SlotTable(keys[0], keys[1])
        assert sorted(table.slots(keys[0], keys[1]).tolist()) == list(range(n))
        assert (table.slots(keys[0], keys[1] + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        SlotTable(np.zeros(2, np.uint64), np.zeros(2, np.uint64))
