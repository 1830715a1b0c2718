"""N-gram Jaccard join by R-trees over count vectors.

A document is the set of its distinct shingles. Hashing the shingles into groups makes a
point of group counts; the overlap of two sets is at most the sum of the smaller counts.
An R-tree over the points keeps the largest count of every group per node, so the same
sum bounds the overlap of a set with anything below a node. What the bound leaves is
verified on the sets.

One tree over everything would prune little (points of unrelated texts are alike in every
group), so trees are built per block. Blocks come from the prefix filter: if two sets
reach the similarity, they share a shingle among the first ``n - needed + 1`` of either,
in any common order of shingles. The order is by hash, but frequent shingles come last;
so a passage that many unrelated documents share makes no block, except for documents
that consist of it.

The trees first take out of every block the sets that the bound leaves no partner; that is
nearly all of them, and only points move for it. Links among the others are found in three
steps, each exact in what it decides. ``grow`` runs through the blocks of every set's first
shared shingle (then its first three, then the large blocks of its first ``EARLY``), each
block split into parts of bounded size, and verifies all pairs that are not connected yet;
so a group of near copies is connected along the way and its pairs are not listed. ``rest``
takes what is left, pairs in any block that may be similar, are still in different
components and were not verified before. It lists no pairs either: each block says in as
many rows as it has which of its sets such pairs connect, the sets that are connected over
all blocks make a group, and the pairs of a group are verified as those of a block, each
set being moved once. Components follow from the links.

Documents with equal sets are one vertex. Sets are made anew from the texts where they
are needed, and only for documents that share a prefix shingle with others.

Defined results: a text without words, empty or null has no shingles and is linked with
nothing; one with fewer words than ``width`` has one; rows without an id take part, and
their component is the smallest id they are linked with, or null; repeated rows are
linked; rows that share an id but not the text are told apart. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.llm.components import components
from answerlog.llm.steps import Steps
from answerlog.llm.textkit import lean, mix, shingle_sets
from answerlog.session import small_batches

LEAF = 16
PART = 6000  # most rows in one task's block
WEIGHT = 6_000_000  # most shingles of sets in one task's block, 8 bytes each
EARLY = 10  # first shingles of a set whose large blocks are verified as a whole
SMALL = 24  # blocks up to this size are taken pair by pair
BROADCAST = 2_000_000  # most keys that are broadcast, 8 bytes each


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with which sets of n and m shingles are similar."""
    return -(-percent * (n + m) // (100 + percent))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Shingles per group; 255 stands for 255 or more. Larger sets have more groups."""
    groups = 128 if len(shingles) <= 1024 else 512 if len(shingles) <= 8192 else 2048
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """A vector in fewer groups."""
    if len(vector) == groups:
        return vector
    parts = vector.reshape(-1, groups).astype(np.int64)
    return np.where((parts == 255).any(0), 255, np.minimum(parts.sum(0), 255)).astype(np.uint8)


def overlap_bound(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Largest possible overlap with each row; a full count bounds nothing."""
    least = np.minimum(rows, point)
    bound = least.sum(axis=-1, dtype=np.int64)
    if point.max(initial=0) == 255 and (full := (least == 255).any(axis=-1)).any():
        bound[full] = np.iinfo(np.int64).max
    return bound


class CountTree:
    """R-tree over count vectors: sorted by size and by the most varying group, packed in
    leaves; a node keeps the largest count of every group and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = max(LEAF, int(np.sqrt(len(order) * LEAF)))
        axis = int(points.astype(np.float32).var(axis=0).argmax()) if len(points) else 0
        parts = [order[i : i + slab] for i in range(0, len(order), slab)]
        order = np.concatenate([p[np.argsort(points[p, axis], kind="stable")] for p in parts])
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        boxes, low, high = self.points, self.sizes, self.sizes
        self.levels = []
        while len(boxes) > 1:
            cuts = np.arange(0, len(boxes), LEAF)
            boxes = np.maximum.reduceat(boxes, cuts, axis=0)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((boxes, low, high))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places in the input whose sets can be similar to a set with this point and size."""
        at = np.zeros(1, np.int64)
        for boxes, low, high in reversed(self.levels):
            at = at[at < len(boxes)]
            fits = (100 * high[at] >= percent * size) & (percent * low[at] <= 100 * size)
            at = at[fits]
            at = at[overlap_bound(boxes[at], point) >= needed(low[at], size, percent)]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)] if self.levels else np.arange(len(self.points))
        own = self.sizes[at]
        at = at[(100 * own >= percent * size) & (percent * own <= 100 * size)]
        at = at[overlap_bound(self.points[at], point) >= needed(self.sizes[at], size, percent)]
        return self.order[at]


class _Union:
    def __init__(self, labels: np.ndarray):
        _, self.root = np.unique(labels, return_inverse=True)

    def join(self, x: int, others: np.ndarray) -> None:
        self.root[np.isin(self.root, self.root[others])] = self.root[x]


def block_links(sets: list[np.ndarray], comps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar in one block and not connected yet. Every pair of
    different components is decided, unless a link found before connects it."""
    sizes = np.array([len(s) for s in sets])
    vectors = [count_vector(s) for s in sets]
    least = min(len(v) for v in vectors)
    points = np.array([folded(v, least) for v in vectors])
    tree = CountTree(points, sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(int(codes.max()) + 1, bool)
    union, links = _Union(comps), []
    largest = np.bincount(union.root).argmax()
    # Pairs of the largest component with others are met from the others' side.
    for x in np.argsort(union.root == largest, kind="stable"):
        if (union.root == union.root[x]).all():
            break
        near = tree.near(points[x], int(sizes[x]), percent)
        near = near[union.root[near] != union.root[x]]
        if not len(near):
            continue
        own = codes[ends[x] - sizes[x] : ends[x]]
        mark[own] = True
        cuts = np.concatenate([[0], np.cumsum(sizes[near])])
        at = np.arange(cuts[-1]) + np.repeat(ends[near] - sizes[near] - cuts[:-1], sizes[near])
        shared = np.add.reduceat(mark[codes[at]].astype(np.int64), cuts[:-1])
        mark[own] = False
        linked = near[shared >= needed(sizes[near], sizes[x], percent)]
        if len(linked):
            _, first = np.unique(union.root[linked], return_index=True)
            links += [(int(x), int(y)) for y in linked[first]]
            union.join(x, linked)
    return links


def _key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    one = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = np.bitwise_xor.reduce(mix(shingles * np.uint64(0x2545F4914F6CDD1D) + np.uint64(11)))
    return int(one.view(np.int64)), int((two + np.uint64(len(shingles))).view(np.int64))


def _describe(width: int):
    """Per document the key and size of its set; per batch also its frequent shingles."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, parts, points = [], [], [], []
            for shingles in shingle_sets(batch.column(1), width):
                points.append(count_vector(shingles).tobytes() if len(shingles) else None)
                keys.append(_key(shingles) if len(shingles) else (None, None))
                sizes.append(len(shingles))
                parts.append(shingles)
            hot: list = [None] * len(sizes)
            if parts:
                # Sets that occur again in the batch count once: copies are no sign of a passage.
                firsts = {key: i for i, key in reversed(list(enumerate(keys)))}.values()
                every = np.sort(np.concatenate([parts[i] for i in firsts]))
                heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else []
                counts = np.diff(np.append(heads, len(every)))
                often = counts >= max(4, len(sizes) // 500)
                hot[0] = [
                    {"shingle": s, "count": c}
                    for s, c in zip(every[heads][often].view(np.int64).tolist(), counts[often].tolist())
                ] if len(every) else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(hot, pa.list_(pa.struct([("shingle", pa.int64()), ("count", pa.int64())]))),
                    pa.array(points, pa.binary()),
                ],
                ["doc_id", "t", "a", "b", "n", "hot", "vector"],
            )

    return describe


def _prefixes(width: int, percent: int, hot):
    """(shingle, a, n) for the prefix of every set, once per task and set."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        late = hot.value
        for batch in batches:
            tokens, owners, lengths, sizes = [np.empty(0, np.uint64)], [], [], []
            for shingles in shingle_sets(batch.column(0), width):
                n = len(shingles)
                if not n:
                    continue
                key = _key(shingles)
                if key in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                length = n - (-(-percent * n // 100)) + 1
                if len(late):
                    at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
                    is_late = late[at] == shingles
                    if is_late.any():
                        shingles = np.concatenate([shingles[~is_late], shingles[is_late]])
                tokens.append(shingles[:length])
                owners.append(key[0])
                lengths.append(length)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens).view(np.int64)),
                    pa.array(np.repeat(np.array(owners, np.int64), lengths)),
                    pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                ],
                ["shingle", "a", "n"],
            )

    return prefixes


def _sets(width: int, wanted):
    """(a, b, set) of the wanted sets, once per task and set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None if wanted is None else wanted.value
        seen: set = set()
        for batch in batches:
            rows = []
            for shingles in shingle_sets(batch.column(0), width):
                if len(shingles):
                    key = _key(shingles)
                    at = 0 if keys is None else np.searchsorted(keys, key[0])
                    if (keys is None or at < len(keys) and keys[at] == key[0]) and key not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(key)
                        rows.append((*key, shingles.tobytes()))
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                ["a", "b", "shingles"],
            )

    return sets


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables with whole runs of equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for i in range(keys):
            values = batch.column(i).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
            if held and held[-1].column(i)[-1].as_py() != values[0]:
                changed[0] = True
        cuts = np.flatnonzero(changed)
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = []
            batch = batch.slice(int(cuts[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _heads(table: pa.Table, keys: int) -> np.ndarray:
    """Starts of the runs of a table, and its length."""
    changed = np.ones(table.num_rows, bool)
    changed[1:] = False
    for i in range(keys):
        values = table.column(i).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)


def _grow_blocks(percent: int):
    """Links of blocks; rows are (shingle, part, v, comp, shingles) sorted by block."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            heads = _heads(table, 2)
            v, comp = (table.column(i).to_numpy() for i in (2, 3))
            links: list[tuple[int, int]] = []
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if b - a < 2:
                    continue
                raw = table.column(4).slice(a, b - a).to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in raw]
                links += [(v[a + x], v[a + y]) for x, y in block_links(sets, comp[a:b], percent)]
            columns = list(zip(*links)) if links else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["x", "y"])

    return grow


def _small_pairs(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside the blocks of up to ``SMALL`` rows, as places in the table."""
    sizes, left, right = np.diff(heads), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        i, j = np.triu_indices(int(size), 1)
        base = heads[:-1][sizes == size][:, None]
        left.append((base + i).ravel())
        right.append((base + j).ravel())
    return np.concatenate(left), np.concatenate(right)


class _Points:
    """Count vectors of some rows in 128 groups, and in more where the rows have more."""

    def __init__(self, raw: list[bytes], n: np.ndarray):
        vectors = [np.frombuffer(x, np.uint8) for x in raw]
        self.n, self.tables = n, []
        for groups in (128, 512, 2048):
            rows = np.array([i for i, x in enumerate(vectors) if len(x) >= groups], np.int64)
            if len(rows):
                place = np.full(len(vectors), -1, np.int64)
                place[rows] = np.arange(len(rows))
                self.tables.append((place, np.array([folded(vectors[i], groups) for i in rows])))
        self.coarse = self.tables[0][1] if self.tables else np.empty((0, 128), np.uint8)

    def similar(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether pairs may be similar, by sizes and then by ever finer points."""
        n = self.n
        fits = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        for place, points in self.tables:
            have = np.flatnonzero(fits & (place[x] >= 0) & (place[y] >= 0))
            step = max(1, 10_000_000 // points.shape[1])
            for low in range(0, len(have), step):
                part = have[low : low + step]
                i, j = x[part], y[part]
                least = np.minimum(points[place[i]], points[place[j]])
                bound = least.sum(1, dtype=np.int64) + np.where((least == 255).any(1), 1 << 60, 0)
                fits[part] = bound >= needed(n[i], n[j], percent)
        return fits


def _partnered(percent: int):
    """The rows of each block that the bound leaves a partner. Rows are (shingle, one, two,
    mine, v, n, vector), sorted by block."""

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            heads = _heads(table, 3)
            n = table.column(5).to_numpy()
            points = _Points(table.column(6).to_pylist(), n)
            has = np.zeros(len(n), bool)
            x, y = _small_pairs(heads)
            fits = points.similar(x, y, percent)
            has[x[fits]] = has[y[fits]] = True
            sizes = np.diff(heads)
            for a, b in zip(heads[:-1][sizes > SMALL].tolist(), heads[1:][sizes > SMALL].tolist()):
                tree = CountTree(points.coarse[a:b], n[a:b])
                for q in range(a, b):
                    if not has[q]:
                        near = a + tree.near(points.coarse[q], int(n[q]), percent)
                        near = near[near != q]
                        near = near[points.similar(np.full(len(near), q), near, percent)]
                        if len(near):
                            has[q] = has[near] = True
            rows = pa.array(np.flatnonzero(has))
            yield pa.RecordBatch.from_arrays(
                [table.column(i).combine_chunks().take(rows) for i in (0, 4, 5)], ["shingle", "v", "n"]
            )

    return partnered


def _stars(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs that connect what the pairs (x, y) connect: each end with the smallest one it
    is connected with. There are fewer of them than ends, however many pairs there are."""
    ends, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(ends))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        while (after != after[after]).any():
            after = after[after]
        label = after[label]
    own = label != np.arange(len(ends))
    return np.stack([ends[label[own]], ends[own]], axis=1)


def _candidates(percent: int):
    """What connects the rows of blocks that may be similar, are in different components and
    were not verified (see ``_stars``). Rows are (shingle, one, two, mine, v, comp, n, vector,
    firsts), sorted by block; ``firsts`` are the shingles in whose blocks all pairs were
    verified."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            heads = _heads(table, 3)
            one, two, mine, v, comp, n = (table.column(i).to_numpy() for i in (1, 2, 3, 4, 5, 6))
            raw = table.column(7).to_pylist()
            lists = table.column(8).to_pylist()
            firsts = np.zeros((len(n), EARLY), np.int64)
            for i, own in enumerate(lists):
                firsts[i, : len(own or ())] = own or ()
            points = _Points(raw, n)
            sizes = np.diff(heads)
            found = [_small_pairs(heads)]
            for a, b in zip(heads[:-1][sizes > SMALL].tolist(), heads[1:][sizes > SMALL].tolist()):
                if (comp[a:b] == comp[a]).all():
                    continue
                tree = CountTree(points.coarse[a:b], n[a:b])
                labels, counts = np.unique(comp[a:b], return_counts=True)
                inside = comp[a:b] == labels[counts.argmax()]
                for q in np.flatnonzero(~inside):
                    near = tree.near(points.coarse[a + q], int(n[a + q]), percent)
                    near = near[(near < q) | inside[near]]
                    found.append((np.full(len(near), a + q), a + near))
            x, y = (np.concatenate(side) for side in zip(*found))
            # A pair of one part of a split block is listed once, a pair of two parts in their block.
            meets = (one[x] == two[x]) | (mine[x] != mine[y])
            keep = meets & (comp[x] != comp[y])
            x, y = x[keep], y[keep]
            fits = points.similar(x, y, percent)
            x, y = x[fits], y[fits]
            verified = np.zeros(len(x), bool)
            for i in range(EARLY):
                for j in range(EARLY):
                    verified |= (firsts[x, i] == firsts[y, j]) & (firsts[x, i] != 0)
            pairs = _stars(v[x[~verified]], v[y[~verified]])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

    return candidates


def row_hash(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(doc_id.isNull(), doc_id, text)


class JaccardJoin:
    """The join of one table of documents; see the module's text."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, width: int, percent: int):
        self.spark: SparkSession = docs.sparkSession
        small_batches(self.spark)
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.width, self.percent = width, percent
        self.saved = Steps(self.spark, "jaccard").saved

    def links(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents with the key of their set, vertices (``v, a, b``), and links (``x, y``)
        that connect every component."""
        rows = self.docs.withColumn("t", row_hash(F.col("doc_id"), F.col("text"))).mapInArrow(
            lean(_describe(self.width)),
            "doc_id long, t long, a long, b long, n long, hot array<struct<shingle:long,count:long>>, "
            "vector binary",
        )
        rows = self.saved(rows, "documents")
        described = rows.select("doc_id", "t", "a", "b", "n")
        vertices = self.saved(
            rows.filter("n > 0").groupBy("a", "b").agg(F.first("n").alias("n"), F.first("vector").alias("vector"))
            .withColumn("v", F.monotonically_increasing_id()),
            "vertices",
        )
        shared = self.shared_shingles(rows, vertices)
        sets = self.sets(shared, vertices)
        edges, comps = self.grow(shared, sets, None, 1)
        for ranks, least in ((3, 2), (EARLY, SMALL + 1)):
            more, comps = self.grow(shared, sets, comps, ranks, least)
            edges = edges.unionByName(more)
        edges = edges.unionByName(self.rest(shared, sets, vertices, comps))
        return described, vertices, edges

    def shared_shingles(self, rows: DataFrame, vertices: DataFrame) -> DataFrame:
        """(shingle, v, n, rank, size, parts, early) of all prefix shingles that two similar
        sets may have: rank by hash among those of the set, number of rows of the shingle,
        parts its block is split into, and its rows of a rank up to ``EARLY``."""
        # A shingle in more than 1/500 of the documents; there are at most 500 times the
        # average number of shingles per document of them.
        least = max(200, rows.count() // 500)
        often = (
            rows.select(F.explode("hot").alias("h")).groupBy("h.shingle").agg(F.sum("h.count").alias("count"))
            .filter(F.col("count") >= least).select("shingle")
        )
        count = often.count()
        late = np.empty(0, np.uint64)
        if 0 < count <= BROADCAST:  # the order is free, so beyond the bound it is by hash alone
            late = np.sort(np.array([r["shingle"] for r in often.collect()], np.int64).view(np.uint64))
        hot = self.spark.sparkContext.broadcast(late)
        prefixes = self.docs.select("text").mapInArrow(
            lean(_prefixes(self.width, self.percent, hot)), "shingle long, a long, n int"
        )
        # A set stays in a block if another set is there, and one next to it in size is near enough.
        by_size = Window.partitionBy("shingle").orderBy("n")
        whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        near = (100 * F.lag("n").over(by_size) >= self.percent * F.col("n")) | (
            self.percent * F.lead("n").over(by_size) <= 100 * F.col("n")
        )
        seen = prefixes.select(
            "shingle", "a", (F.min("a").over(whole) != F.max("a").over(whole)).alias("others"), near.alias("near")
        )
        seen = self.saved(seen.filter("others AND near").select("shingle", "a").distinct(), "shared")
        known = seen.join(vertices.select("a", "v", "n"), "a").select("shingle", "v", "n")
        sizes = known.groupBy("shingle").agg(F.count("*").alias("size")).filter("size > 1")
        placed = self.in_blocks(known, sizes, vertices.select("v", "vector"), ["v", "n", "vector"])
        able = placed.mapInArrow(lean(_partnered(self.percent)), "shingle long, v long, n long").distinct()
        able = self.saved(able, "partnered")
        ranked = able.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("shingle")))
        parts = F.greatest(F.ceil(F.count("*") / F.lit(PART)), F.ceil(F.sum("n") / F.lit(WEIGHT)))
        sizes = ranked.groupBy("shingle").agg(
            F.count("*").alias("size"), parts.cast("long").alias("parts"),
            F.count_if(F.col("rank") <= EARLY).alias("early"),
        )
        return self.saved(ranked.join(sizes, "shingle"), "ranked")

    def in_blocks(self, rows: DataFrame, sizes: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
        """Rows, with what ``points`` has of their vertices, dealt and sorted by block.

        A block of more than ``PART`` rows is split into parts; every two parts (``one``,
        ``two``) meet in a block of their own, and ``mine`` is a row's part. The vectors come
        last, so they are moved once."""
        own = [c for c in rows.columns if c != "shingle"]
        parts = F.ceil(F.col("size") / F.lit(PART)).cast("long")
        rows = rows.join(sizes.select("shingle", parts.alias("parts")), "shingle")
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("v", "shingle"), F.col("parts")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = rows.select(
            "shingle", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"),
            "mine", *own,
        )
        rows = rows.join(points, "v").select("shingle", "one", "two", "mine", *columns)
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(count, "shingle", "one", "two").sortWithinPartitions("shingle", "one", "two")

    def sets(self, shared: DataFrame, vertices: DataFrame) -> DataFrame:
        """(v, shingles) of the vertices that share a prefix shingle."""
        wanted = shared.select("v").distinct().join(vertices.select("v", "a", "b"), "v")
        keys = None
        if wanted.count() <= BROADCAST:
            found = wanted.select("a").toArrow().column("a").to_numpy()
            keys = self.spark.sparkContext.broadcast(np.unique(found))
        made = self.docs.select("text").mapInArrow(lean(_sets(self.width, keys)), "a long, b long, shingles binary")
        joined = made.join(wanted if keys is None else F.broadcast(wanted), ["a", "b"])
        return self.saved(joined.select("v", "shingles").dropDuplicates(["v"]), "sets")

    @staticmethod
    def beside(rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Rows with the sets of their vertices; few rows go to the sets, else both are dealt."""
        return rows.join(sets, "v") if rows.count() > BROADCAST // 4 else sets.join(F.broadcast(rows), "v")

    def grow(
        self, shared: DataFrame, sets: DataFrame, comps: DataFrame | None, ranks: int, least: int = 2
    ) -> tuple[DataFrame, DataFrame]:
        """Links in the blocks, of ``least`` rows or more, of the first ``ranks`` shingles of
        every set, and components."""
        rows = shared.filter(F.col("rank") <= ranks).select("shingle", "v", "parts")
        rows = self.with_comps(rows, comps)
        blocks = rows.groupBy("shingle").agg(
            F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")
        ).filter((F.col("low") != F.col("high")) & (F.col("rows") >= least)).select("shingle")
        part = F.pmod(F.xxhash64("v", "shingle"), F.col("parts"))
        rows = rows.join(blocks, "shingle").withColumn("part", part).drop("parts")
        rows = self.beside(rows, sets).select("shingle", "part", "v", "comp", "shingles")
        count = self.spark.conf.get("spark.sql.shuffle.partitions")
        placed = rows.repartition(int(count), "shingle", "part").sortWithinPartitions("shingle", "part")
        name = f"links-{ranks}"
        edges = self.saved(placed.mapInArrow(lean(_grow_blocks(self.percent)), "x long, y long"), name)
        linked = edges
        if comps is not None:
            linked = edges.unionByName(comps.select(F.col("v").alias("x"), F.col("comp").alias("y")))
        return edges, self.saved(components(linked), f"components-{ranks}")

    @staticmethod
    def with_comps(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
        if comps is None:
            return rows.withColumn("comp", F.col("v"))
        return rows.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))

    def rest(self, shared: DataFrame, sets: DataFrame, vertices: DataFrame, comps: DataFrame) -> DataFrame:
        """Links between different components that growing has not decided."""
        # Pairs in a block that was grown in one part are decided.
        grown = (F.col("rank") <= 3) | ((F.col("rank") <= EARLY) & (F.col("early") > SMALL))
        grown = shared.filter(grown & (F.col("parts") == 1))
        firsts = grown.groupBy("v").agg(F.collect_list("shingle").alias("firsts"))
        points = vertices.select("v", "vector").join(firsts, "v", "left")
        rows = self.with_comps(shared.select("shingle", "v", "n"), comps)
        blocks = rows.groupBy("shingle").agg(
            F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")
        ).filter("low <> high").select("shingle", "size")
        names = ["v", "comp", "n", "vector", "firsts"]
        placed = self.in_blocks(rows, blocks, points, names)
        pairs = placed.mapInArrow(lean(_candidates(self.percent)), "x long, y long").distinct()
        groups = components(self.saved(pairs, "candidates")).select("v", F.col("comp").alias("group"))
        rows = self.with_comps(groups.join(vertices.select("v", "n"), "v"), comps)
        parts = F.greatest(F.ceil(F.count("*") / F.lit(PART)), F.ceil(F.sum("n") / F.lit(WEIGHT)))
        rows = rows.join(rows.groupBy("group").agg(parts.cast("long").alias("parts")), "group")
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("v"), F.col("parts")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        part = F.least("mine", "other") * F.lit(1 << 31) + F.greatest("mine", "other")
        rows = self.beside(rows.select("group", part.alias("part"), "v", "comp"), sets)
        rows = rows.select("group", "part", "v", "comp", "shingles")
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(count, "group", "part").sortWithinPartitions("group", "part")
        return self.saved(dealt.mapInArrow(lean(_grow_blocks(self.percent)), "x long, y long"), "links-rest")


def jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (documents with equal sets share it) and
    ``component_id``, the smallest id reachable by links, for every document."""
    described, vertices, edges = JaccardJoin(docs, doc_id, text, width, percent).links()
    comps = components(edges)
    named = vertices.join(comps, "v", "left").select("a", "b", F.coalesce("comp", "v").alias("comp"))
    firsts = described.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    labelled = named.join(firsts, ["a", "b"])
    roots = labelled.groupBy("comp").agg(F.min("doc_id").alias("root"))
    labels = labelled.join(roots, "comp").select("a", "b", "root")
    result = described.join(labels, ["a", "b"], "left")
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.concat_ws(":", "a", "b")).alias("set_key"),
        F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """``docs`` with one row of every component, that with the smallest id (a null is largest);
    of equal rows one stays. Rows without words are in no component and all stay."""
    described, vertices, edges = JaccardJoin(docs, doc_id, text, width, percent).links()
    named = vertices.join(components(edges), "v", "left").select("a", "b", F.coalesce("comp", "v").alias("comp"))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t")
    stay = described.filter("n > 0").join(named, ["a", "b"]).groupBy("comp").agg(F.min(order).alias("row"))
    stay = stay.select(F.coalesce("row.doc_id", F.lit(0)).alias("__llm_id"), F.col("row.t").alias("__llm_t"))
    has_words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    id_ = F.col(doc_id).cast("long")
    keyed = docs.filter(has_words).withColumns({"__llm_id": F.coalesce(id_, F.lit(0)), "__llm_t": row_hash(id_, F.col(text))})
    one = keyed.join(stay, ["__llm_id", "__llm_t"]).dropDuplicates(["__llm_id", "__llm_t"]).select(*docs.columns)
    return one.unionByName(docs.filter(~has_words))
