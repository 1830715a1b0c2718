"""Packing of tokenized documents into sequences: bounded-space online packing.

Every partition keeps at most ``windows`` open windows. A document's ids (with the end id)
are cut into full sequences and a rest; the rest goes to the open window in which it
leaves least space. If it fits in none, the fullest window is emitted and a new one is
opened; a window with more than ``slack`` free places is first filled with the beginning
of the rest, so that little is padded. What is open at the end of a partition is merged
over all partitions: windows, as they are, by best fit in the same bounded space.

Tokenizing keeps the ids of words that are not plain (see ``_Tokenizer``) in a store that
is emptied when full and at the end of a task; neither it nor anything else here grows
with the input. A document's ids are held while it is cut, as they are its text.

Defined results: a null or empty text has no ids but the end id; ids depend on the text
alone; repeated rows are packed each on its own; a null id stays null; an empty table
gives no rows; of the input only the id and the text are used.
"""

from __future__ import annotations

import base64
import itertools
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from answerlog.llm.textkit import give_back
from answerlog.session import new_folder, small_batches

STORE = 1_200_000  # words whose ids are kept
BLOCK = 1 << 20  # characters that are encoded at once
ROWS = 256  # texts that are Python strings at once
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, is_open boolean"
)


class _Tokenizer:
    """Ids of whole texts as the tokenizer file gives them, without added special tokens.

    The byte-level pattern never joins a character that is no white space with white space
    after it. So ids of a text are those of its words, each with the one space or line end
    before it. A stretch of plain words (basic and accented Latin, digits, punctuation) goes
    through the same vocabulary's ranks in one call; each other word goes to the tokenizer
    itself, and its ids are kept. A text with any other white space goes there as it is.
    """

    PLAIN = "!-;=?-~À-ÖØ-öø-ſ"
    ODD = re.compile(rf"[^{PLAIN} \n]+")
    OTHER_WHITE = re.compile(r"[^\S \n]")
    GAP = re.compile("[ \n]")

    def __init__(self, path: str, ranks_path: str, pattern: str):
        self.whole = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        vocabulary = self.whole.get_vocab()
        if len(ranks) > len(vocabulary):
            raise ValueError("the ranks are not those of the tokenizer")
        self.ranks = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.after: dict[str, dict[str, bytes]] = {" ": {}, "\n": {}, "": {}}

    def slow(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> Iterator[bytes]:
        """Ids of plain words, of about ``BLOCK`` characters at once."""
        at = 0
        while at < len(text):
            gap = self.GAP.search(text, at + max(BLOCK, 1))
            end = gap.start() if gap else len(text)
            yield array("I", self.ranks.encode_ordinary(text[at:end])).tobytes()
            at = end

    def word(self, text: str, before: str) -> bytes:
        store = self.after[before]
        known = store.get(text)
        if known is None:
            if len(store) > STORE:
                store.clear()
            known = store[text] = self.slow(before + text)
        return known

    def forget(self) -> None:
        """Empty the stores. Workers outlive their tasks, and other stages need the memory."""
        for store in self.after.values():
            store.clear()

    def parts(self, text: str) -> Iterator[bytes]:
        """Ids of a text whose words have one space or line end between them."""
        at = 0
        for odd in self.ODD.finditer(text):
            if odd.start() < at:
                continue  # in the word just taken
            begin = max(at, text.rfind(" ", at, odd.start()), text.rfind("\n", at, odd.start()))
            yield from self.plain(text[at:begin])
            gap = self.GAP.search(text, odd.end())
            at = gap.start() if gap else len(text)
            before = text[begin] if text[begin] in self.after else ""
            yield self.word(text[begin + len(before) : at], before)
        yield from self.plain(text[at:])

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            spaced = text.replace("\n", " ")
            if "<|" in text or "  " in spaced or spaced != spaced.strip(" ") or self.OTHER_WHITE.search(text):
                yield self.slow(text)
            else:
                yield b"".join(self.parts(text))


@cache
def _tokenizer(path: str, ranks_path: str, pattern: str) -> _Tokenizer:
    return _Tokenizer(path, ranks_path, pattern)


class _Windows:
    """Open windows of one task: (free places, window), smallest free first."""

    def __init__(self, size: int, most: int, slack: int, first_id: int):
        self.size, self.most, self.slack = size, most, slack
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.numbers = itertools.count(first_id)

    def full(self, item: tuple) -> list[tuple[int, list]]:
        """A window of its own for an item that fills it."""
        return [(next(self.numbers), [item])]

    def put(self, length: int, item: tuple) -> list[tuple[int, list]]:
        """Place by best fit where it fits; what this fills is emitted."""
        at = bisect_left(self.free, (length, -1))
        if at == len(self.free):
            at = 0
            window, space = next(self.numbers), self.size
            self.held[window] = []
        else:
            space, window = self.free.pop(at)
        self.held[window].append(item)
        if space == length:
            return [(window, self.held.pop(window))]
        insort(self.free, (space - length, window))
        return []

    def fits(self, length: int) -> bool:
        return bool(self.free) and self.free[-1][0] >= length

    def fullest(self) -> tuple[int, int]:
        return self.free[0]

    def emit_fullest(self) -> list[tuple[int, list]]:
        _, window = self.free.pop(0)
        return [(window, self.held.pop(window))]

    def crowded(self) -> bool:
        return len(self.free) >= self.most


def _pack(path: str, ranks_path: str, pattern: str, end_id: int, size: int, windows: int, slack: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(done: list[tuple[int, list]], is_open: bool = False) -> Iterator[tuple]:
        for window, items in done:
            offset = 0
            for doc_id, start, ids, total in items:
                yield doc_id, start, len(ids) // 4, ids, total, window, offset, is_open
                offset += len(ids) // 4

    def place(state: _Windows, doc_id, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while total - start >= size:
            yield from rows(state.full((doc_id, start, ids[4 * start : 4 * (start + size)], total)))
            start += size
        while start < total:
            rest = total - start
            if not state.fits(rest) and state.crowded():
                space, _ = state.fullest()
                if space > state.slack:
                    yield from rows(state.put(space, (doc_id, start, ids[4 * start : 4 * (start + space)], total)))
                    start += space
                    continue
                yield from rows(state.emit_fullest())
            yield from rows(state.put(rest, (doc_id, start, ids[4 * start :], total)))
            start = total

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        tokenizer = _tokenizer(path, ranks_path, pattern)
        state = _Windows(size, windows, slack, TaskContext.get().partitionId() << 33)
        found: list[tuple] = []
        weight = 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = batch.column(1).fill_null("").to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_batch(texts)):
                for row in place(state, doc_id, ids + end):
                    found.append(row)
                    weight += 60 + len(row[3])
                    if weight > 8 << 20:
                        yield _batch(found)
                        found, weight = [], 0
        found += rows(list(state.held.items()), True)
        yield _batch(found)
        tokenizer.forget()
        give_back()

    return pack


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_open"]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _merge(size: int, windows: int):
    """Best fit of left-over windows, longest first; each keeps its pieces' order."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Windows(size, windows, 0, 0)

        def rows(done: list[tuple[int, list]]) -> Iterator[tuple[int, int, int]]:
            for _, items in done:
                base = 0
                for window, length in items:
                    yield window, items[0][0], base
                    base += length

        found: list[tuple[int, int, int]] = []
        for batch in batches:
            for window, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not state.fits(length) and state.crowded():
                    found += rows(state.emit_fullest())
                found += rows(state.put(length, (window, length)))
        found += rows(list(state.held.items()))
        columns = list(zip(*found)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["sequence_id", "merged_id", "base"]
        )

    return merge


def packing(
    docs: DataFrame, path: str, ranks_path: str, pattern: str, size: int = 2048, end_id: int = 1,
    windows: int = 64, slack: int = 16, doc_id: str = "doc_id", text: str = "text",
    payload: Column | None = None, merge_group: int = 20_000,
) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``start`` and ``length`` in its ids, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` there.

    ``payload`` is an expression over ``ids`` that is kept in their place, under its own
    name. The pieces are written to the shared folder once, as merging needs them again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = F.col("ids") if payload is None else payload
    packed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _pack(path, ranks_path, pattern, end_id, size, windows, slack), PIECES
    )
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "is_open"]
    folder = new_folder(spark, "pieces")
    packed.select(*names, kept).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    names = [c for c in pieces.columns if c != "is_open"]
    left = pieces.filter("is_open")
    lengths = left.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    groups = max(1, lengths.count() // merge_group)
    spread = lengths.repartition(groups, F.xxhash64("sequence_id")).sortWithinPartitions(
        F.desc("length"), "sequence_id"
    )
    merged = spread.select("sequence_id", "length").mapInArrow(
        _merge(size, windows), "sequence_id long, merged_id long, base long"
    )
    moved = left.join(merged, "sequence_id").withColumns(
        {"sequence_id": F.col("merged_id"), "offset": F.col("offset") + F.col("base")}
    )
    return pieces.filter("NOT is_open").select(*names).unionByName(moved.select(*names))
