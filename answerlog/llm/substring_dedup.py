"""Substring dedup by sliding sentence spans.

A sentence ends after a word that ends in '.', '!' or '?' and at a line end. One of more
than ``longest`` words (so that it cannot hide a passage) is cut by its content: after the
word of least hash in each of its windows of ``longest`` words. Where two texts share P
words in a row, their cuts agree from at most ``longest`` words behind the start of these
to less than ``longest`` words before their end, wherever the sentences around them begin;
at least P - 2 * ``longest`` + 1 words are cut alike.

A span is a run of sentences that has at least ``least`` sentences and ``words`` words, and
no more sentences than that takes: the shortest one from each sentence on, and the shortest
one up to each sentence. A longer run holds, for each of its sentences, a span from that
sentence on or one up to a sentence behind it that covers it; so these stand for every run
of several sentences, and repeated runs go whole. Spans are equal if their words are,
whatever white space is between them; where equal words are divided differently, as in a
text of one word again and again, only the shortest spans are compared. The first place of a span is the one with the
smallest (id, text hash, sentence); all others are repeats, and every sentence that a
repeat covers goes.

Spans are counted by their hash alone (96 bits), combined before the shuffle. Only spans
that occur again are then emitted with their places: the texts are hashed once more, and
as long as the repeated hashes are few (``BROADCAST``, checked) their list goes to the
tasks; beyond that all places are emitted and joined.

Defined results: null and empty texts have no sentences and stay as they are; rows equal
in id and text are one document and all get its result; rows that share only the id are
documents of their own, ordered by their text's hash; null ids come last. Other columns
pass through. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlog.llm.steps import Steps
from answerlog.llm.textkit import PART, document_blocks, give_back, lean, mix, powers, text_bytes, word_bounds, span_hashes
from answerlog.session import small_batches

Rule = tuple[int, int, int]  # least, words, longest
BROADCAST = 4_000_000
ENDS = np.zeros(256, bool)
ENDS[list(b".!?")] = True


def content_cuts(hashes: np.ndarray, starts: np.ndarray, longest: int) -> np.ndarray:
    """First words of the pieces that sentences of more than ``longest`` words are cut into:
    those after the least hash (the last one of equals) of every window inside a sentence."""
    count = len(hashes)
    if count <= longest:
        return np.empty(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    least = (hashes & ~low) | (low - np.arange(count, dtype=np.uint64))
    size = 1
    while size < longest:
        step = min(size, longest - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    sizes = np.diff(np.append(starts, count))
    room = np.repeat(starts + sizes, sizes)[: len(least)] - np.arange(len(least))
    inside = (room >= longest) & (np.repeat(sizes, sizes)[: len(least)] > longest)
    after = np.unique((low - (least[inside] & low)).astype(np.int64)) + 1
    return after[after < count]


class Sentences:
    """Sentences and spans of some whole texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, words: int, longest: int):
        begin, end, heads = word_bounds(data, offsets)
        self.begin, self.end = begin, end
        self.hashes = span_hashes(data, begin, end, False)
        count = len(begin)
        owner = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        first = np.ones(count, bool)
        if count > 1:
            breaks = ENDS[data[end[:-1] - 1]] | (lines[begin[1:]] > lines[end[:-1]]) | (owner[1:] != owner[:-1])
            first[1:] = breaks
        starts = np.flatnonzero(first)
        first[content_cuts(self.hashes, starts, longest)] = True
        self.starts = np.flatnonzero(first)  # first word of every sentence
        self.stops = np.append(self.starts[1:], count)
        self.owner = owner[self.starts]
        self.heads = np.searchsorted(self.owner, np.arange(len(heads)))  # first sentence of every text
        # Last sentence of the span from each sentence on.
        by_words = np.searchsorted(self.stops, self.starts + words)
        last = np.maximum(by_words, np.arange(len(self.starts)) + least - 1)
        inside = last < self.heads[self.owner + 1] if len(self.owner) else np.zeros(0, bool)
        self.span_first = np.flatnonzero(inside)
        self.span_last = last[inside]
        if len(self.owner):
            # First sentence of the shortest span up to each sentence; those known already are left out.
            every = np.arange(len(self.starts))
            by_words = np.searchsorted(self.starts, self.stops - words, side="right") - 1
            head = np.minimum(by_words, every - least + 1)
            inside = head >= self.heads[self.owner]
            inside[inside] = last[head[inside]] != every[inside]
            self.span_first = np.concatenate([self.span_first, head[inside]])
            self.span_last = np.concatenate([self.span_last, every[inside]])

    def span_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits that stand for the words of every span."""
        up, down = powers(len(self.hashes))
        low, high = self.starts[self.span_first], self.stops[self.span_last]
        found = []
        for salt in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03):
            total = np.zeros(len(self.hashes) + 1, np.uint64)
            np.cumsum(mix(self.hashes ^ np.uint64(salt)) * up[: len(self.hashes)], out=total[1:])
            found.append(mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64)))
        return found[0].view(np.int64), (found[1] >> np.uint64(33)).astype(np.int32)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for first, last in document_blocks(offsets, PART):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def _keys(rule: Rule):
    """(a, b) of every span."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _texts(batch.column(0)):
                a, b = Sentences(data, offsets, *rule).span_keys()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return keys


def _places(rule: Rule, wanted):
    """(a, b, doc, t, first, last) of every span whose hash is wanted."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = batch.column(0), batch.column(1)
            for low, _, data, offsets in _texts(batch.column(2)):
                own = Sentences(data, offsets, *rule)
                a, b = own.span_keys()
                keep = np.arange(len(a))
                if wanted is not None:
                    known = wanted.value
                    keep = keep[:0]
                    if len(known):
                        at = np.minimum(np.searchsorted(known, a), len(known) - 1)
                        keep = np.flatnonzero(known[at] == a)
                owner = own.owner[own.span_first[keep]]
                head = own.heads[owner]
                rows = pa.array(owner + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a[keep]), pa.array(b[keep]), doc.take(rows), t.take(rows),
                        pa.array((own.span_first[keep] - head).astype(np.int64)),
                        pa.array((own.span_last[keep] - head).astype(np.int64)),
                    ],
                    ["a", "b", "doc", "t", "first", "last"],
                )

    return places


def _cut(rule: Rule):
    """Text without the covered sentences, their number, and the number of all sentences."""

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept, removed, every = [], [], []
        for text, covered in zip(texts, spans):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            own = Sentences(data, np.array([0, len(data)]), *rule)
            gone = np.zeros(len(own.starts) + 1, np.int64)
            for span in covered.as_py() or ():
                gone[span["first"]] += 1
                gone[span["last"] + 1] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            removed.append(int(gone.sum()))
            every.append(len(own.starts))
            if not gone.any():
                kept.append(text.as_py())
                continue
            # A sentence goes with the white space after it.
            edges = np.append(own.begin[own.starts], len(data))
            edges[0] = 0
            raw = data.tobytes()
            kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in np.flatnonzero(~gone)).decode())
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array(every, pa.int64())],
            ["text", "n_removed", "n_sentences"],
        )

    return cut


def substring_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 2, words: int = 20,
    longest: int = 16, into: str = "dedup",
) -> DataFrame:
    """``docs`` with a struct ``into``: the remaining ``text``, ``n_removed`` and
    ``n_sentences``. An input column of that name is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    saved = Steps(spark, "spans").saved
    rule = (least, words, longest)
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))
    body = F.coalesce(F.col(text), F.lit(""))
    # Equal documents give equal rows here, so counting one document's copies needs distinct places.
    t = F.xxhash64(F.col(doc_id).isNull(), doc, body)
    texts = docs.select(doc.alias("doc"), t.alias("t"), body.alias("text"))
    counted = texts.select("text").mapInArrow(lean(_keys(rule)), "a long, b int").groupBy("a", "b").agg(
        F.count("*").alias("n")
    )
    repeated = saved(counted.filter("n > 1").select("a", "b"), "repeated")
    known = None
    if repeated.count() <= BROADCAST:
        found = repeated.select("a").toArrow().column("a").to_numpy()
        known = spark.sparkContext.broadcast(np.unique(found))
    places = texts.mapInArrow(
        lean(_places(rule, known)), "a long, b int, doc long, t long, first long, last long"
    )
    places = saved(places.join(repeated, ["a", "b"]).distinct(), "places")
    place = F.struct("doc", "t", "first")
    firsts = places.groupBy("a", "b").agg(F.min(place).alias("earliest"))
    again = places.join(firsts, ["a", "b"]).filter(place != F.col("earliest"))
    covered = again.groupBy("doc", "t").agg(F.collect_set(F.struct("first", "last")).alias("__llm_spans"))
    keyed = docs.withColumns({"__llm_doc": doc, "__llm_t": t})
    joined = keyed.join(
        covered.withColumnsRenamed({"doc": "__llm_doc", "t": "__llm_t"}), ["__llm_doc", "__llm_t"], "left"
    )
    kind = "struct<text:string,n_removed:bigint,n_sentences:bigint>"
    cut = F.arrow_udf(_cut(rule), kind)(F.col(text), F.col("__llm_spans"))
    return joined.withColumn(into, cut).drop("__llm_doc", "__llm_t", "__llm_spans")
