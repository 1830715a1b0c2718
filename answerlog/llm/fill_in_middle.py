"""Fill-in-middle transformation: documents cut in three and put in another order.

Cuts are given in code points, texts are held as UTF-8 bytes. ``ByteIndex`` turns the one
into the other by a sparse index: only the characters of more than one byte are recorded,
each with its position in code points and the excess bytes up to it. The place of a cut is
its number plus the excess bytes before it, found by binary search; a text of ASCII alone
has an empty index and the place is the number itself. One index serves a whole block of
texts, so all cuts of a block are found by two searches.

Everything is a function of one row, so there is no shuffle and a lost executor costs no
more than its own rows.

Defined results: a null text is empty; an empty text and one that holds a marker stay
plain; a null id is hashed as an empty one; repeated rows get equal results; an empty
table gives no rows; other columns pass through, an input column named like the result is
replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlog.llm.textkit import document_blocks, text_bytes

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Layout:
    """Markers of the three parts, and of a hundred documents how many stay plain and how
    many of the others begin with the suffix. ``seed`` changes all draws."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    suffix_first_percent: int = 20
    seed: int = 1


class ByteIndex:
    """Code points and bytes of a block of UTF-8 texts."""

    def __init__(self, data: np.ndarray):
        self.leads = np.flatnonzero(data >= 0xC0)
        first = data[self.leads]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.excess = np.zeros(len(excess) + 1, np.int64)
        np.cumsum(excess, out=self.excess[1:])
        self.points = self.leads - self.excess[:-1]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Code points before each place in bytes; places lie between characters."""
        if not len(self.leads):
            return places
        return places - self.excess[np.searchsorted(self.leads, places)]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        if not len(self.leads):
            return points
        return points + self.excess[np.searchsorted(self.points, points)]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cut(layout: Layout) -> Callable[..., pa.Array]:
    p, s, m = (x.encode() for x in (layout.prefix, layout.suffix, layout.middle))

    def run(text: pa.Array, one: pa.Array, two: pa.Array, three: pa.Array, four: pa.Array) -> pa.Array:
        text = text.fill_null("")
        h1, h2, h3, h4 = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (one, two, three, four))
        plain = h3 % 100 >= 100 - layout.plain_percent
        for marker in (layout.prefix, layout.suffix, layout.middle):
            plain |= pc.match_substring(text, marker).to_numpy(zero_copy_only=False)
        spm = h4 % 100 < layout.suffix_first_percent
        data, offsets = text_bytes(text)
        n = np.zeros(len(text), np.int64)
        a, b = n.copy(), n.copy()
        output: list[bytes] = []
        for first, last in document_blocks(offsets):
            rows, edges = slice(first, last), offsets[first : last + 1] - offsets[first]
            block = data[offsets[first] : offsets[last]]
            index = ByteIndex(block)
            heads = index.to_points(edges)
            n[rows] = np.diff(heads)
            cuts = np.sort([h1[rows] % (n[rows] + 1), h2[rows] % (n[rows] + 1)], axis=0)
            a[rows], b[rows] = cuts
            places = index.to_bytes(heads[:-1] + cuts)
            raw = block.tobytes()
            for i, x, y, low, high in zip(range(first, last), *places.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                if plain[i] or low == high:
                    output.append(raw[low:high])
                elif spm[i]:
                    output.append(b"".join((s, raw[y:high], p, raw[low:x], m, raw[x:y])))
                else:
                    output.append(b"".join((p, raw[low:x], s, raw[y:high], m, raw[x:y])))
        plain |= n == 0
        form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
        texts = pa.array(output, pa.binary()).cast(pa.string())
        columns = [pa.array(n), form, pa.array(a, mask=plain), pa.array(b - a, mask=plain), texts]
        return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(
    docs: DataFrame, layout: Layout = Layout(), doc_id: str = "doc_id", text: str = "text", into: str = "fim"
) -> DataFrame:
    """``docs`` with a struct column ``into``: ``n`` (code points), ``form`` (plain, psm or
    spm), ``prefix_chars`` and ``middle_chars`` (null if plain) and the ``output``."""
    cut = F.arrow_udf(_cut(layout), RESULT)
    return docs.withColumn(into, cut(F.col(text), *_draws(F.col(doc_id), layout.seed)))


def restored(output: Column, form: Column, layout: Layout = Layout()) -> Column:
    """The text that an output was made of; a null output stays null."""
    p, s, m = (x.encode() for x in (layout.prefix, layout.suffix, layout.middle))

    def whole(raw: bytes | None, kind: str) -> bytes | None:
        if raw is None or kind == "plain":
            return raw
        one, two = (p, s) if kind == "psm" else (s, p)
        second = raw.index(two, len(one))
        third = raw.index(m, second + len(two))
        parts = raw[len(one) : second], raw[second + len(two) : third], raw[third + len(m) :]
        return parts[0] + parts[2] + parts[1] if kind == "psm" else parts[1] + parts[2] + parts[0]

    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        raws = outputs.cast(pa.binary()).to_pylist()
        return pa.array(list(map(whole, raws, forms.to_pylist())), pa.binary()).cast(pa.string())

    return F.arrow_udf(run, "string")(output, form)
