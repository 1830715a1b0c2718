"""Quality rules: base counts, then divergence from language references.

Per document the histograms of character classes and of common words are compared with
the references of the languages by the Jensen-Shannon distance (base 2, so 0 to 1). The
references are sums over all documents of a language that pass the base rules; what
reaches the driver is one row per language of the parameter ``languages``. A histogram
that is too short says nothing and is not judged (``min_chars``, ``min_words``).

Defined results: a null or empty text has no words and is rejected; a null or unknown
``lang`` adds to no reference but is judged against all of them (the smallest distance
counts, so a wrong ``lang`` does no harm); without any reference nothing is rejected by
distance; repeated rows are judged one by one; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlog.llm import textkit
from answerlog.session import small_batches

# Frequent function words of the languages (ASCII spellings only).
COMMON_WORDS = {
    "en": "the of and to in is that for with as on at by this from are was or an be it a",
    "fr": "de la le et les des en un du une que est pour qui dans sur par au pas avec",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "es": "de la que el en y a los del se las por un para con no una su al lo como",
}
WORDS = sorted({word for words in COMMON_WORDS.values() for word in words.split()})
# Character classes, each a set of code points; what is in none is "other".
CLASSES = ["lower", "upper", "digit", "space", "sentence", "symbol", "other", "letter"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules. A distance is judged from the given length on."""

    least_words: int = 20
    repeat_percent: int = 30
    min_chars: int = 300
    class_distance: float = 0.3
    min_words: int = 100
    word_distance: float = 0.335


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = T.StructType(
    [T.StructField(name, T.LongType()) for name in COUNTS]
    + [T.StructField(name, T.ArrayType(T.LongType())) for name in ("classes", "common")]
)


def _class_table() -> np.ndarray:
    """Class of a code point by its first UTF-8 byte; 8 marks the bytes that follow it."""
    table = np.full(256, 6, np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[list(b".,;:!?'\"()-")] = 4
    table[list(b"#*$%&|<>")] = 5
    table[0x80:0xC0], table[0xC0:] = 8, 7
    return table


_CLASS = _class_table()


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common words, bare or before one '.' or ',', and their bins."""
    forms = [(word + end).encode() for word in WORDS for end in ("", ".", ",")]
    data = np.frombuffer(b" ".join(forms), np.uint8)
    begin, end, _ = textkit.word_bounds(data, np.array([0, len(data)]))
    hashes = textkit.span_hashes(data, begin, end, True)
    order = np.argsort(hashes)
    return hashes[order], (np.arange(len(forms)) // 3)[order]


def _repeated(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which values occur twice or more with the same owner."""
    own = values ^ textkit.mix(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(own)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(own), bool)
    at = np.searchsorted(twice, own)
    return twice[np.minimum(at, len(twice) - 1)] == own


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of all lines that hold a word."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    after = np.append(breaks, len(data))
    end = np.minimum(after[np.searchsorted(breaks, begin)], offsets[owner + 1])
    filled = np.concatenate([[0], np.cumsum(~textkit.WHITE[data])])
    some = filled[end] > filled[begin]
    return begin[some], end[some], owner[some]


def count_batch(column: pa.Array) -> pa.Array:
    hashes, bins = _common_table()
    data, offsets = textkit.text_bytes(column)
    count = len(offsets) - 1
    n_words, chars, symbols, lines, repeat = (np.zeros(count, np.int64) for _ in range(5))
    classes = np.zeros((count, len(CLASSES)), np.int64)
    common = np.zeros((count, len(WORDS) + 1), np.int64)
    for first, last in textkit.document_blocks(offsets, textkit.PART):
        part = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        size = last - first
        row = np.repeat(np.arange(size), np.diff(at))
        for low in range(0, len(part), textkit.BLOCK):
            piece = slice(low, low + textkit.BLOCK)
            cells = np.bincount(row[piece] * 9 + _CLASS[part[piece]], minlength=size * 9)
            classes[first:last] += cells.reshape(size, 9)[:, :8]
        words, heads = textkit.word_hashes(part, at, False)
        owner = np.repeat(np.arange(size), np.diff(heads))
        n_words[first:last] = np.diff(heads)
        folded, _ = textkit.word_hashes(part, at, True)
        place = np.minimum(np.searchsorted(hashes, folded), len(hashes) - 1)
        known = hashes[place] == folded
        cell = np.where(known, bins[place], len(WORDS))
        counted = np.bincount(owner * (len(WORDS) + 1) + cell, minlength=size * (len(WORDS) + 1))
        common[first:last] = counted.reshape(size, -1)
        if len(words) >= 8:
            runs = textkit.window_hashes(words, 8)
            inside = owner[: len(runs)] == owner[7:]
            begin = np.flatnonzero(inside)
            begin = begin[_repeated(runs[begin], owner[begin])]
            steps = np.zeros(len(words) + 1, np.int64)
            steps[begin] += 1
            steps[begin + 8] -= 1
            repeat[first:last] = np.bincount(owner[np.cumsum(steps[:-1]) > 0], minlength=size)
        begin, end, owner = _lines(part, at)
        if len(begin):
            key = textkit.span_hashes(part, begin, end, False) ^ textkit.mix(owner.astype(np.uint64) + np.uint64(1))
            _, earliest = np.unique(key, return_index=True)
            lines[first:last] = np.bincount(owner, minlength=size) - np.bincount(owner[earliest], minlength=size)
    chars[:] = classes.sum(1) - classes[:, 3]
    symbols[:] = classes[:, 5]

    def lists(table: np.ndarray) -> pa.Array:
        width = table.shape[1]
        return pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * width, table.ravel())

    columns = [pa.array(x) for x in (n_words, chars, symbols, lines, repeat)] + [lists(classes), lists(common)]
    return pa.StructArray.from_arrays(columns, [*COUNTS, "classes", "common"])


def base_counts(text: Column) -> Column:
    """Base counts and both histograms of whole texts; a null text counts as empty."""

    def count(column: pa.Array) -> pa.Array:
        found = count_batch(column)
        textkit.give_back()
        return found

    return F.arrow_udf(count, FEATURES)(text)


def base_failed(counts: Column, limits: Limits) -> Column:
    few = counts["n_words"] < limits.least_words
    return few | (100 * counts["n_repeat_words"] > limits.repeat_percent * counts["n_words"])


def references(
    docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits(),
    languages: tuple[str, ...] = tuple(COMMON_WORDS),
) -> dict[str, list[list[int]]]:
    """Summed histograms (classes, common words) per language over all documents.

    Failed documents get a null in place of their histograms. A filter would be moved below
    the counts, which would then be made twice, side by side in two workers of a task.
    """
    c = base_counts(F.col(text))
    passed = F.when(~base_failed(c, limits), F.struct(c["classes"].alias("classes"), c["common"].alias("common")))
    counted = docs.filter(F.col(lang).isin(*languages)).select(F.col(lang).alias("lang"), passed.alias("c"))
    sums = [F.sum(F.col("c.classes")[i]).alias(f"a{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.col("c.common")[i]).alias(f"b{i}") for i in range(len(WORDS) + 1)]
    rows = counted.groupBy("lang").agg(*sums).collect()
    cut = len(CLASSES) + 1
    return {row["lang"]: [list(row)[1:cut], list(row)[cut:]] for row in rows if row["a0"] is not None}


def js_distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of counts to one reference histogram."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = np.broadcast_to(reference / reference.sum(), p.shape)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return np.sqrt(np.maximum(parts.sum(1) / 2, 0))


def judged_counts(known: dict[str, list[list[int]]], text: Column) -> Column:
    """``base_counts`` with the least distances to the references in place of the histograms;
    null where there is nothing to compare."""
    tables = [[np.array(kinds[i], float) for kinds in known.values() if sum(kinds[i])] for i in (0, 1)]
    fields = [*FEATURES.fields[: len(COUNTS)], T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(name, T.DoubleType()) for name in ("class_distance", "word_distance")]

    def judge(column: pa.Array) -> pa.Array:
        found = count_batch(column)
        columns = [found.field(name) for name in COUNTS]
        distances = []
        for name, references in zip(("classes", "common"), tables):
            counts = found.field(name).values.to_numpy().reshape(len(found), -1)
            if name == "classes":
                columns.append(pa.array(counts.sum(1)))
            if references and len(found):
                least = np.min([js_distances(counts, x) for x in references], axis=0)
                distances.append(pa.array(least, mask=counts.sum(1) == 0))
            else:
                distances.append(pa.nulls(len(found), pa.float64()))
        textkit.give_back()
        return pa.StructArray.from_arrays(columns + distances, [field.name for field in fields])

    return F.arrow_udf(judge, T.StructType(fields))(text)


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits(),
    into: str = "quality",
) -> DataFrame:
    """``docs`` with a struct column ``into``: the base counts, ``base_failed``, the two
    distances and ``kept``. An input column of that name is replaced."""
    small_batches(docs.sparkSession)
    known = references(docs, text, lang, limits)
    c = F.col("__llm_counts")
    far = (c["n_chars"] >= limits.min_chars) & (c["class_distance"] > limits.class_distance)
    far |= (c["n_words"] >= limits.min_words) & (c["word_distance"] > limits.word_distance)
    failed = base_failed(c, limits)
    judged = F.struct(
        *[c[name].alias(name) for name in COUNTS],
        failed.alias("base_failed"),
        c["class_distance"].alias("class_distance"),
        c["word_distance"].alias("word_distance"),
        (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"),
    )
    rows = docs.withColumn("__llm_counts", judged_counts(known, F.col(text)))
    return rows.withColumn(into, judged).drop("__llm_counts")
