"""SentencePiece BPE encoding by a table of prefixes, and decoding.

A sequence of pieces is the BPE encoding of a text exactly if every two neighbours are
compatible, that is, if their joint string encodes to just these two. So every prefix of a
text has exactly one piece that can end it: of all pieces that match there (found by one
automaton over the vocabulary) the one that is compatible with the last piece of the
prefix before it. The table of last pieces is filled from left to right, the ids are read
backwards. This needs an order of all merges. Runs of spaces have none, as their pieces
share one score; stretches with such a run are merged in order of score and place instead.

No piece crosses a pair of characters that is inside no piece, so a text is encoded
stretch by stretch, and the ids of a stretch are kept for the next text with it. The store
of a worker is emptied when it holds ``STORE`` stretches; results do not depend on it.

Defined results: a null or empty text has no pieces but the begin and end ids; characters
outside the vocabulary become byte pieces. Other columns pass through; input columns named
like the results are replaced; repeated rows are encoded alike; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
STORE = 1_200_000
STRETCHES = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Codec:
    """Encoder and decoder of one model file (BPE, byte fallback, identity normaliser)."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, train = model.normalizer_spec, model.trainer_spec
        fits = train.model_type == 2 and train.byte_fallback and not spec.precompiled_charsmap
        fits = fits and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        kinds = {piece.type for piece in model.pieces}
        if not fits or not kinds <= {1, 2, 3, 6} or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and an identity normaliser")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        names = {name: i for i, name in enumerate(p.piece for p in model.pieces)}
        self.begin, self.end = names[train.bos_piece], names[train.eos_piece]
        shown = {1: lambda p: p.piece.replace(SPACE, " ").encode(), 6: lambda p: bytes([int(p.piece[3:5], 16)]),
                 2: lambda p: train.unk_surface.encode(), 3: lambda p: b""}
        surfaces = [shown[p.type](p) for p in model.pieces]
        self.sizes = np.array([len(x) for x in surfaces])
        self.heads = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.pieces = {i: piece for piece, i in self.ids.items()}
        self.inner = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        if any(SPACE in piece[1:] and piece.strip(SPACE) for piece in self.ids) or "\n" in "".join(self.ids):
            raise ValueError("pieces with spaces or line ends inside are not supported")
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        for piece, i in sorted(self.ids.items(), key=lambda item: -self.scores[item[0]]):
            if piece == SPACE or not piece.startswith(SPACE * 2) and piece.strip(SPACE):
                if len(piece) == 1 or self.merge(piece, self.halves) == [i]:
                    self.automaton.add_word(piece, (i, len(piece)))
                    self.spines[i] = self.spine(piece, 0), self.spine(piece, 1)
        self.automaton.make_automaton()
        self.lengths = {i: len(piece) for piece, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.after_space: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def merge(self, text: str, halves: dict[str, tuple[str, str]] | None = None) -> list[int]:
        """Encode by merging neighbours, best score first, then leftmost; ``halves`` takes
        down what the text, if it is a piece, was merged from."""
        parts, left = list(text), list(range(-1, len(text) - 1))
        right = list(range(1, len(text) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(parts) and (score := self.scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score, a, parts[a] + parts[b]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, joint = heapq.heappop(heap)
            b = right[a]
            if not parts[a] or b >= len(parts) or parts[a] + parts[b] != joint:
                continue
            if halves is not None and joint == text:
                halves[text] = parts[a], parts[b]
                if any(len(half) > 1 and self.scores[half] <= self.scores[text] for half in halves[text]):
                    raise ValueError("a piece ranks before its halves")
            parts[a], parts[b], right[a] = joint, "", right[b]
            if right[a] < len(parts):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [i for part in parts if part for i in self.of_part(part)]

    def of_part(self, part: str) -> list[int]:
        known = self.ids.get(part)
        return [known] if known is not None else [self.bytes[b] for b in part.encode("utf-8", "replace")]

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The symbols at one edge of a piece while it is merged, latest first, each with the
        rank of the merge that made it (characters are there from the start)."""
        steps = []
        while len(piece) > 1:
            steps.append((piece, -self.scores[piece]))
            piece = self.halves[piece][side]
        return [*steps, (piece, -math.inf)]

    def compatible(self, one: int, two: int) -> bool:
        """Whether the joint string of two pieces encodes to just these two, that is, whether
        no two symbols that are neighbours at some time join across the border. The merges on
        both sides are undone from the latest on; of equal ranks the left one came first."""
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        left, right = self.spines[one][1], self.spines[two][0]
        i = j = 0
        left_ends = right_ends = math.inf
        fits = True
        while True:
            (a, a_rank), (b, b_rank) = left[i], right[j]
            score = self.scores.get(a + b)
            if score is not None and -score < left_ends and -score <= right_ends:
                fits = False
                break
            if a_rank == b_rank == -math.inf:
                break
            if a_rank > b_rank:
                left_ends, i = a_rank, i + 1
            else:
                right_ends, j = b_rank, j + 1
        self.pairs[one << 32 | two] = fits
        return fits

    def stretch(self, text: str) -> bytes:
        """Ids of a text without line ends, little-endian, by the table of prefixes."""
        if SPACE * 2 in text:
            return array("I", self.merge(text)).tobytes()
        # Last piece of every prefix; -1 where the last character is in no piece, and at the start.
        last, tests, none = [-1] * (len(text) + 1), self.pairs.get, -1
        for place, (piece, size) in self.automaton.iter(text):
            end = place + 1
            if last[end] != none:
                continue
            before = last[end - size]
            if before != none:
                fits = tests(before << 32 | piece)
                if fits or fits is None and self.compatible(before, piece):
                    last[end] = piece
            else:  # nothing before, or a character in no piece, with which nothing clashes
                last[end] = piece
        ids: list[int] = []
        at = len(text)
        while at:
            piece = last[at]
            if piece < 0:
                ids += reversed(self.of_part(text[at - 1]))
                at -= 1
            else:
                ids.append(piece)
                at -= self.lengths[piece]
        ids.reverse()
        return array("I", ids).tobytes()

    def word(self, text: str, spaced: bool) -> bytes:
        """Ids of a word without spaces and line ends, after a space or not."""
        store = self.after_space if spaced else self.plain
        known = store.get(text)
        if known is None:
            if len(store) > STORE:
                store.clear()
            body = text[:-1]
            if body and text[-1] in ".,;:!?" and (body[-1], text[-1]) not in self.inner:
                known = self.word(body, spaced) + self.word(text[-1], False)
            elif text:
                known = self.stretch(SPACE + text if spaced else text)
            else:
                known = self.stretch(SPACE) if spaced else b""
            store[text] = known
        return known

    def encode(self, text: str) -> bytes:
        """All ids of a text with the begin and end ids, as little-endian 32-bit integers."""
        ends = np.array([self.begin, self.end], "<u4")
        head, tail = ends[:1].tobytes(), ends[1:].tobytes()
        if not text:
            return head + tail
        parts: list[bytes] = [head]
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " " or " \n" in text:
            for part in STRETCHES.findall(SPACE + text.replace(" ", SPACE)):
                if part == "\n":
                    parts.append(self.word("\n", False))
                elif part[0] == SPACE and SPACE not in part[1:]:
                    parts.append(self.word(part[1:], True))
                else:
                    parts.append(self.word(part, False) if part[0] != SPACE else self.stretch(part))
            return b"".join(parts) + tail
        line_end = self.word("\n", False)
        for number, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if number:
                parts.append(line_end)
                parts.append(self.word(words[0], False))
                words = words[1:]
            elif words == [""]:
                parts.append(self.word("", True))
                words = []
            found = list(map(self.after_space.get, words))
            if None in found:
                found = [self.word(w, True) if x is None else x for w, x in zip(words, found)]
            parts += found
        return b"".join(parts) + tail

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text; every byte that fits no character becomes U+FFFD."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.heads[ids] - (ends - sizes), sizes)
        data = self.surface[at]
        first = np.flatnonzero(sizes)
        # The space that encoding puts in front goes, if the first shown piece is no byte piece.
        if len(first) and data[0] == 32 and int(ids[first[0]]) in self.pieces:
            data = data[1:]
        raw = data.tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return _each_byte(raw).encode()


def _each_byte(raw: bytes) -> str:
    """Decode UTF-8 with U+FFFD for every single byte that fits no character."""
    parts: list[str] = []
    while raw:
        try:
            parts.append(raw.decode())
            break
        except UnicodeDecodeError as error:
            parts.append(raw[: error.start].decode() + "�" * (error.end - error.start))
            raw = raw[error.end :]
    return "".join(parts)


@cache
def codec(path: str) -> Codec:
    """The codec of a model file, built once per worker."""
    return Codec(path)


def encode(text: Column, path: str) -> Column:
    """Ids of whole texts with begin and end ids, as little-endian unsigned 32-bit integers."""

    def run(column: pa.Array) -> pa.Array:
        model = codec(path)
        return pa.array([model.encode(text or "") for text in column.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def decode(ids: Column, path: str) -> Column:
    """Texts of ids as ``encode`` gives them; a null stays null."""

    def run(column: pa.Array) -> pa.Array:
        model = codec(path)
        texts = [None if x is None else model.decode(np.frombuffer(x, "<u4")) for x in column.to_pylist()]
        return pa.array(texts, pa.binary()).cast(pa.string())

    return F.arrow_udf(run, "string")(ids)


def sentencepiece_codec(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, see ``encode``), ``n_tokens`` and ``decoded``."""
    rows = docs.withColumn("ids", encode(F.col(text), path))
    rows = rows.withColumn("decoded", decode(F.col("ids"), path))
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
