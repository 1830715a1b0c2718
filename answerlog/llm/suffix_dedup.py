"""Suffix-array dedup: remove every byte that lies in a repeated string of ``length`` bytes.

A window is a string of ``length`` bytes; it goes if it also starts anywhere else. Suffix
arrays are built per shard. Shards of documents would have to be merged each with each, so
shards are cut from another order: windows are dealt by the least hash among their grams
(``gram`` bytes). Equal windows have equal grams, hence the same least hash, and meet. A
text is emitted as pieces, the runs of windows with one least hash; only pieces whose hash
occurs again are cut out (one snippet of their bytes) and go to the shards, and equal
snippets go once.

A shard is some ``SHARD`` bytes of snippets in hash order. Its suffixes are sorted by
refining groups of equal prefixes (Larsson and Sadakane: ranks of twice the length from
ranks at two places, only for groups not yet apart), common prefixes follow in text order
(Kasai: the next suffix shares at most one byte less), and neighbours that share
``length`` bytes are repeated. Snippets of one hash that lie in two shards are merged by
binary search in the other shard's sorted windows. A hash with more than ``hot`` distinct
snippets (a line that very many texts share) is split further: its windows are dealt one
by one by their 128-bit hash.

Defined results: null and empty texts have no bytes and lose none. Equal texts of
``length`` bytes or more lose everything, shorter texts nothing. Repeated rows are equal
texts. Rows without an id are treated like others. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlog.llm.steps import Steps
from answerlog.llm.textkit import document_blocks, lean, mix, powers, text_bytes, _BYTES
from answerlog.session import small_batches

SHARD = 1 << 20  # sorting it holds 50 to 95 times as much
MOST_WINDOWS = 256
MOST_ROWS = 4096  # windows that are searched side by side


def least_hashes(data: np.ndarray, gram: int, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and the least of every ``windows`` consecutive ones."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[False][data] * up[: len(data)], out=total[1:])
    hashes = mix((total[gram:] - total[:-gram]) * down[: len(data) + 1 - gram])
    # Minimum over a sliding window: a running one from the left and from the right of blocks.
    count = len(hashes) - windows + 1
    padded = np.full(-(-len(hashes) // windows) * windows, np.iinfo(np.uint64).max)
    padded[: len(hashes)] = hashes
    blocks = padded.reshape(-1, windows)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return hashes, np.minimum(backward[:count], forward[windows - 1 : windows - 1 + count])


def occurs_twice(hashes: np.ndarray, windows: int, firsts: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the least hash of a run of windows is that of two grams of the run or more."""
    view = np.lib.stride_tricks.sliding_window_view(hashes, windows)
    twice = np.zeros(len(firsts), bool)
    for low in range(0, len(firsts), 4096):
        part = slice(low, low + 4096)
        value, lasts = least[part, None], firsts[part] + sizes[part] - 1
        left = firsts[part] + (view[firsts[part]] == value).argmax(axis=1)
        right = lasts + windows - 1 - (view[lasts][:, ::-1] == value).argmax(axis=1)
        twice[part] = left != right
    return twice


def _pieces(length: int, gram: int):
    """(hash, key, first, count, twice) of all runs of windows with one least hash; ``twice``
    tells that two of its own grams have it, so windows may repeat inside the run."""
    windows = length - gram + 1

    def of_text(data: np.ndarray) -> tuple[np.ndarray, ...]:
        hashes, least = least_hashes(data, gram, windows)
        heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        sizes = np.diff(np.append(heads, len(least)))
        if sizes.max() > MOST_WINDOWS:
            parts = -(-sizes // MOST_WINDOWS)
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            firsts = np.repeat(heads, parts) + within * MOST_WINDOWS
            ends = np.repeat(heads + sizes, parts)
            heads, sizes = firsts, np.minimum(MOST_WINDOWS, ends - firsts)
        return least[heads], heads, sizes, occurs_twice(hashes, windows, heads, sizes, least[heads])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            keys = batch.column(0).to_pylist()
            for first, last in document_blocks(offsets):
                found = []
                for i in range(first, last):
                    if keys[i] in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(keys[i])
                    low, high = int(offsets[i]), int(offsets[i + 1])
                    # Windows in stretches, so that a very long text takes no more memory.
                    for at in range(low, high - length + 1, 1 << 22):
                        part = of_text(data[at : min(high, at + (1 << 22) + length - 1)])
                        found.append((keys[i], part[0], part[1] + (at - low), part[2], part[3]))
                if found:
                    sizes = [len(f[1]) for f in found]
                    owners = pa.array(np.repeat(np.arange(len(found), dtype=np.int32), sizes))
                    names = pa.DictionaryArray.from_arrays(owners, pa.array([f[0] for f in found], pa.binary()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([f[1] for f in found]).view(np.int64)),
                            names.cast(pa.binary()),
                            pa.array(np.concatenate([f[2] for f in found]).astype(np.int64)),
                            pa.array(np.concatenate([f[3] for f in found]).astype(np.int32)),
                            pa.array(np.concatenate([f[4] for f in found])),
                        ],
                        ["hash", "key", "first", "count", "twice"],
                    )

    return pieces


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros after the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros(len(data), np.uint64)
    for j in range(8):
        keys = (keys << np.uint64(8)) | wide[j : j + len(data)]
    return keys


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of what follows them, compared over ``depth`` bytes at least."""
    n = len(data)
    keys = packed(data)
    order = np.argsort(keys)
    ordered = keys[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    known = 8
    while known < depth:
        alone = heads & np.append(heads[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        place = order[at]
        both = rank[place] * (n + 2) + rank[np.minimum(place + known, n)] + 1
        again = np.argsort(both)
        both = both[again]
        order[at] = place[again]
        heads[at[1:]] |= both[1:] != both[:-1]
        rank[order[at]] = np.maximum.accumulate(np.where(heads[at], at, 0))
        known *= 2
    return order


def common_prefixes(
    data: np.ndarray, keys: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, cap: int
) -> np.ndarray:
    """Bytes, up to ``cap``, that each window shares with the one sorted before it.

    Kasai's rule in text order, over all snippets side by side: the window one byte on
    shares at least one byte less, if its old neighbour has a window one byte on too, and
    that is sorted before it (as prefixes are capped, equal windows may be in any order)."""
    rank = np.full(len(data) + 1, -1, np.int64)
    rank[order] = np.arange(len(order))
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(len(data), np.int64)
    lanes = np.argsort(-counts, kind="stable")
    held = np.zeros(len(lanes), np.int64)
    for j in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts[lanes], -j, side="left"))
        s = starts[lanes[:live]] + j
        t = before[s]
        if j:
            old = before[s - 1]
            follows = (old >= 0) & (rank[old + 1] >= 0) & (rank[old + 1] < rank[s])
            h = np.where(follows, np.maximum(held[:live] - 1, 0), 0)
        else:
            h = np.zeros(live, np.int64)
        open_ = np.flatnonzero(t >= 0)
        h[t < 0] = 0
        while len(open_):
            more = h[open_] + 8 <= cap
            more[more] = keys[s[open_[more]] + h[open_[more]]] == keys[t[open_[more]] + h[open_[more]]]
            open_ = open_[more]
            h[open_] += 8
        open_ = np.flatnonzero((t >= 0) & (h < cap))
        while len(open_):
            open_ = open_[data[s[open_] + h[open_]] == data[t[open_] + h[open_]]]
            h[open_] += 1
            open_ = open_[h[open_] < cap]
        held[:live] = h
        shared[s] = h
    return shared


class Shard:
    """Sorted windows of some snippets, and which of them are repeated."""

    def __init__(self, snippets: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(snippets), np.uint8)
        sizes = np.array([len(x) for x in snippets], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.counts = sizes - length + 1
        self.repeated = np.zeros(len(self.data), bool)
        valid = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(valid, self.starts, 1)
        np.add.at(valid, self.starts + self.counts, -1)
        valid = np.cumsum(valid[:-1]) > 0
        order = suffix_array(self.data, length)
        self.order = order[valid[order]]
        shared = common_prefixes(self.data, packed(self.data), self.order, self.starts, self.counts, length)
        again = shared[self.order] >= length
        self.repeated[self.order[again]] = True
        self.repeated[self.order[np.flatnonzero(again) - 1]] = True

    def windows(self, snippets: range) -> np.ndarray:
        """Places of the windows of some consecutive snippets."""
        some = slice(snippets.start, snippets.stop)
        return np.concatenate(
            [np.arange(a, a + c) for a, c in zip(self.starts[some].tolist(), self.counts[some].tolist())]
        )

    def merge(self, other: Shard, mine: np.ndarray, theirs: np.ndarray) -> None:
        """Mark windows of both shards that are equal, by binary search in the other's order."""
        span = np.arange(self.length)
        wanted = np.zeros(len(other.data), bool)
        wanted[theirs] = True
        order = other.order[wanted[other.order]]
        # All equal windows of the other shard follow each other in its order.
        found = np.zeros(len(order) + 1, np.int64)
        for at in range(0, len(mine), MOST_ROWS):
            part = mine[at : at + MOST_ROWS]
            rows = self.data[part[:, None] + span]
            low = _lower(other, order, rows, span)
            place = order[np.minimum(low, len(order) - 1)]
            equal = (other.data[place[:, None] + span] == rows).all(axis=1)
            self.repeated[part[equal]] = True
            upper = _upper(other, order, rows[equal], low[equal], span)
            np.add.at(found, low[equal], 1)
            np.add.at(found, upper, -1)
        other.repeated[order[np.cumsum(found[:-1]) > 0]] = True

    def intervals(self, number: int) -> Iterator[tuple[int, int]]:
        """Runs of repeated windows of a snippet, first and last."""
        a, c = int(self.starts[number]), int(self.counts[number])
        flags = np.concatenate([[0], self.repeated[a : a + c].astype(np.int8), [0]])
        steps = np.diff(flags)
        yield from zip(np.flatnonzero(steps == 1).tolist(), (np.flatnonzero(steps == -1) - 1).tolist())


def _lower(other: Shard, order: np.ndarray, rows: np.ndarray, span: np.ndarray) -> np.ndarray:
    """First place whose window is not less than the row, by binary search."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        there = other.data[order[middle][:, None] + span]
        differ = there != rows[open_]
        place = differ.argmax(axis=1)
        each = np.arange(len(open_))
        less = differ[each, place] & (there[each, place] < rows[open_][each, place])
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def _upper(other: Shard, order: np.ndarray, rows: np.ndarray, low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """First place after ``low`` whose window is greater than the row, by binary search."""
    low, high = low.copy(), np.full(len(low), len(order))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        there = other.data[order[middle][:, None] + span]
        differ = there != rows[open_]
        place = differ.argmax(axis=1)
        each = np.arange(len(open_))
        greater = differ[each, place] & (there[each, place] > rows[open_][each, place])
        low[open_[~greater]] = middle[~greater] + 1
        high[open_[greater]] = middle[greater]


def _shards(length: int, size: int):
    """(hash, name, a, b): repeated windows a to b of a snippet; rows come in hash order."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        weight = 0
        waiting: list[tuple[Shard, list[tuple]]] = []  # shards that end inside a hash, hashes and names

        def build() -> None:
            shard = Shard([row[2] for row in rows], length)
            hashes = [row[0] for row in rows]
            if waiting and waiting[-1][1][-1][0] == hashes[0]:
                mine = shard.windows(range(0, _count(hashes, hashes[0])))
                for other, own in waiting:
                    names = [row[0] for row in own]
                    if names[-1] == hashes[0]:
                        theirs = range(len(names) - _count(names[::-1], hashes[0]), len(names))
                        shard.merge(other, mine, other.windows(theirs))
            waiting.append((shard, [row[:2] for row in rows]))

        def emit(keep_last: bool) -> pa.RecordBatch:
            found = []
            last = waiting[-1][1][-1][0] if waiting else None
            done = len(waiting)
            if keep_last:
                done = next(i for i, (_, own) in enumerate(waiting) if own[-1][0] == last)
            for shard, own in waiting[:done]:
                for number, row in enumerate(own):
                    found += [(row[0], row[1], a, b) for a, b in shard.intervals(number)]
            del waiting[:done]
            columns = list(zip(*found)) if found else [[], [], [], []]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["hash", "name", "a", "b"]
            )

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append(row)
                weight += len(row[2])
                if weight > size:
                    build()
                    rows, weight = [], 0
                    yield emit(True)
        if rows:
            build()
        yield emit(False)

    return shards


def _count(values: list, value) -> int:
    """How many values at the beginning of a list equal ``value``."""
    return next((i for i, x in enumerate(values) if x != value), len(values))


def _snippets(length: int):
    """Bytes of the wanted pieces of a text."""

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, pieces in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = [
                    (p["hash"], key, p["first"], text[p["first"] : p["first"] + p["count"] + length - 1])
                    for p in pieces
                ]
                hashes, keys, firsts, bodies = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes, pa.int64()), pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()),
                        pa.array([hashlib.md5(b).digest() for b in bodies], pa.binary()), pa.array(bodies, pa.binary()),
                    ],
                    ["hash", "key", "first", "name", "snippet"],
                )

    return snippets


def _single_windows(length: int):
    """(hash, name, window, a) for every window of a snippet."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hash_, name, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                count = len(body) - length + 1
                found = [hashlib.blake2b(body[a : a + length], digest_size=16).digest() for a in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hash_] * count, pa.int64()), pa.array([name] * count, pa.binary()),
                        pa.array(found, pa.binary()), pa.array(range(count), pa.int32()),
                    ],
                    ["hash", "name", "window", "a"],
                )

    return windows


KEPT = "key binary, n_removed long, n_spans long, kept binary"


def _keep(length: int):
    """What is left of a text without its repeated windows."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kept, at, removed, count = [], 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"] + length) for s in spans):
                    if a > end:
                        count += 1
                        kept.append(text[at:a])
                        removed += b - a
                        end = at = b
                    elif b > end:
                        removed += b - end
                        end = at = b
                kept.append(text[at:])
                rows.append((key, removed, count, b"".join(kept)))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "n_removed", "n_spans", "kept"]
            )

    return keep


def suffix_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, gram: int = 64,
    hot: int = 2000, shard: int = SHARD, payload: Column | None = None,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``
    (binary, the remaining bytes) of every document.

    ``payload`` is an expression over ``kept`` that takes its place, under its own name, so
    that texts need not be moved to the documents."""
    spark = docs.sparkSession
    small_batches(spark)
    saved = Steps(spark, "suffixes").saved
    payload = F.col("kept") if payload is None else payload
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("kept"))
    rows = rows.withColumns({"key": F.unhex(F.md5("kept")), "n_bytes": F.octet_length("kept").cast("long")})
    long = rows.filter(F.col("n_bytes") >= length).select("key", F.col("kept").alias("text"))
    pieces = long.mapInArrow(
        lean(_pieces(length, gram)), "hash long, key binary, first long, count int, twice boolean"
    )
    pieces = saved(pieces, "pieces")
    # The same text may come from several tasks; a hash in equal pieces of it only is alone.
    place = F.xxhash64("key", "first")
    again = pieces.groupBy("hash").agg(
        F.min(place).alias("low"), F.max(place).alias("high"), F.max("twice").alias("twice")
    )
    again = again.filter("twice OR low <> high").select("hash")
    wanted = pieces.join(again, "hash").groupBy("key").agg(
        F.collect_set(F.struct("hash", "first", "count")).alias("pieces")
    )
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    candidates = saved(texts.join(wanted, "key").select("key", "text", "pieces"), "candidates")
    snippets = saved(
        candidates.mapInArrow(
            lean(_snippets(length)), "hash long, key binary, first long, name binary, snippet binary"
        ),
        "snippets",
    )
    named = snippets.groupBy("hash", "name").agg(F.first("snippet").alias("snippet"), F.count("*").alias("n"))
    named = saved(named, "named")
    whole = named.filter("n > 1").select(
        "hash", "name", F.lit(0).alias("a"), (F.octet_length("snippet") - length).alias("b")
    )
    crowds = named.groupBy("hash").agg(F.count("*").alias("names"))
    crowds = crowds.select("hash", (F.col("names") > hot).alias("crowded"))
    told = named.join(crowds, "hash").select("hash", "name", "snippet", "crowded")
    few = told.filter("NOT crowded").select("hash", "name", "snippet")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = few.repartition(count, "hash").sortWithinPartitions("hash", "name")
    by_shard = sorted_.mapInArrow(lean(_shards(length, shard)), "hash long, name binary, a int, b int")
    single = told.filter("crowded").select("hash", "name", "snippet").mapInArrow(
        lean(_single_windows(length)), "hash long, name binary, window binary, a int"
    )
    single = saved(single, "single")
    twice = single.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    one_by_one = single.join(twice, "window").select("hash", "name", "a", F.col("a").alias("b"))
    repeated = saved(whole.unionByName(by_shard).unionByName(one_by_one), "windows")
    spans = snippets.select("hash", "name", "key", "first").join(repeated, ["hash", "name"]).groupBy("key").agg(
        F.collect_list(F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b")))
        .alias("spans")
    )
    changed = candidates.select("key", "text").join(spans, "key").select("key", "text", "spans")
    kept = changed.mapInArrow(lean(_keep(length)), KEPT).select("key", "n_removed", "n_spans", payload)
    kept = saved(kept, "kept")
    name = kept.columns[-1]
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    empty = spark.range(1).select(F.lit("").cast("binary").alias("kept")).select(payload)
    results = kept.join(copies.select("key"), "key", "left_anti").select(
        "key", "n_removed", "n_spans", F.col(name).alias("_left"), F.lit(False).alias("_all")
    ).unionByName(
        copies.select(
            "key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
            F.lit(None).cast(empty.schema[0].dataType).alias("_left"), F.lit(True).alias("_all"),
        )
    )
    nothing = F.lit(empty.first()[0]).cast(empty.schema[0].dataType)
    joined = rows.select("doc_id", "key", "n_bytes", payload).join(results, "key", "left")
    return joined.select(
        "doc_id", "n_bytes",
        F.when(F.col("_all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("_all"), nothing).otherwise(F.coalesce("_left", name)).alias(name),
    )
