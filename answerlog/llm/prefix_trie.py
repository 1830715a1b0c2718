"""Prefix trie of conversations: how much their beginnings share.

Every distinct sequence of first turns is a node. Prefixes are known by digests: a turn's
hash depends on its place, and the digest of a prefix is the sum of its turns' hashes
modulo 2**64, in two lanes. So digests of a conversation are running sums, and pieces of a
long conversation are summed apart and shifted afterwards. Two visits of one digest that
differ in parent, depth or size stop the job.

1. Conversations are cut into units of at most ``levels`` turns of depth; a unit is one
   row that holds its path in flat arrays.
2. Nodes come from one aggregate over all visits, combined before the shuffle, so a
   beginning that a third of all conversations share is no hot key.
3. Subtrees of at most ``limit`` visits go whole to one shard. The nodes above them, the
   crown, are few: nodes of one depth with over V / 4096 of V visits below number under
   4,096, and ``limit`` grows until the crown has at most ``most`` nodes.
4. A shard gives its node digests the slots of a minimal perfect hash (``SlotTable``),
   checks each slot against the digest it holds, scatters the counts into flat arrays by
   slot, and adds them up through the array of parent slots, deepest level first. What
   belongs to a parent outside goes on as one row per parent: first into the crown, which
   is one more shard, then into the units above. There is one such round for every
   ``levels`` levels of the deepest conversation.
5. Ids of the conversations that end at a node are sorted over all tasks and joined into
   texts of bounded length; only these texts meet in the task that hashes them.

Defined results: turns are in ascending order of ``turn``, nulls first, turns of equal
number by the hash of role and text; null roles and texts are empty; rows with a null id
belong to no conversation; repeated rows are repeated turns; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlog.llm.long_runs import LongGroups
from answerlog.llm.steps import Steps
from answerlog.llm.textkit import mix

Batches = Iterator[pa.RecordBatch]
BORROWED = 8
KEY, PARENT = ["key0", "key1"], ["parent0", "parent1"]


class SlotTable:
    """A minimal perfect hash of distinct two-word keys.

    Each level is a bit array of about the number of keys left; a key that has a bit for
    itself stays there, the others go on. A key's slot is the number of bits before its
    own. The keys stand in their slots, so a lookup tells members from strangers.
    """

    def __init__(self, key0: np.ndarray, key1: np.ndarray):
        left = np.arange(len(key0))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        slots = np.empty(len(key0), np.int64)
        used = 0
        while len(left):
            size = len(left) + (len(left) >> 2) + 1
            at = self._place(key0[left], key1[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = used + np.cumsum(alone) - alone
            self.levels.append((alone, rank))
            settled = alone[at]
            slots[left[settled]] = rank[at[settled]]
            used += int(alone.sum())
            if not settled.any() and len(self.levels) > 200:
                raise ValueError("the keys are not distinct")
            left = left[~settled]
        self.key0, self.key1 = np.empty_like(key0), np.empty_like(key1)
        self.key0[slots], self.key1[slots] = key0, key1
        if (self.slots(key0, key1) != slots).any():
            raise ValueError("a key is not in its slot")

    @staticmethod
    def _place(key0: np.ndarray, key1: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix((key0 ^ seed) * np.uint64(0xD1342543DE82EF95) + mix(key1 + seed)) % np.uint64(size)).astype(np.int64)

    def slots(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for strangers."""
        found = np.full(len(key0), -1, np.int64)
        left = np.arange(len(key0))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(key0[left], key1[left], level, len(alone))
            here = alone[at]
            slot, own = rank[at[here]], left[here]
            same = (self.key0[slot] == key0[own]) & (self.key1[slot] == key1[own])
            found[own[same]] = slot[same]
            left = left[~here]
        return found


def _words(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


# The turns of rebuilt conversations


@dataclass(frozen=True)
class Rebuild:
    """How many turns a conversation borrows (at most ``BORROWED``), and from which one;
    by default none, so conversations stay as they are."""

    borrowed: Callable[[Column], Column] = lambda c: F.lit(0)
    source: Callable[[Column], Column] = lambda c: c


def _numbered(turns: DataFrame, long: LongGroups) -> DataFrame:
    """``c, i, hash0, hash1, size`` with the number ``i`` of the turn, from 1."""
    order = [F.asc_nulls_first("turn"), F.asc("hash0"), F.asc("hash1")]
    short = turns.filter(~long.holds()) if long else turns
    done = short.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy(*order)).cast("long"))
    if long:
        spread = long.ranged(turns.filter(long.holds()), "range")
        sizes = spread.groupBy("c", "range").count()
        before = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        shift = sizes.select("c", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
        place = F.row_number().over(Window.partitionBy("c", "range").orderBy(*order))
        placed = spread.withColumn("i", place).join(F.broadcast(shift), ["c", "range"])
        done = done.unionByName(placed.withColumn("i", F.col("i") + F.col("shift")).drop("range", "shift"))
    return done.drop("turn")


def rebuilt_turns(
    conversations: DataFrame, rebuild: Rebuild, conv_id: str, turn: str, role: str, text: str, **limits: int
) -> DataFrame:
    """``c, pos, hash0, hash1, size, total``: the turns of the rebuilt conversations and, as
    place 0, their textless beginning; ``total`` is the number of turns."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    # Two signed words of the hash; the uppermost bit of each is left out.
    words = [F.conv(F.substring(said, at, 15), 16, 10).cast("long").alias(f"hash{i}") for i, at in enumerate((1, 17))]
    turns = conversations.select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), *words, F.octet_length(text).alias("size")
    ).filter("c IS NOT NULL")
    long = LongGroups.of(turns, "c", "turn", **limits)
    numbered = _numbered(turns, long)

    counts = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    lent = counts.select(F.col("c").alias("source"), F.col("n").alias("lent"))
    known = counts.withColumns({"source": rebuild.source(F.col("c")), "h": rebuild.borrowed(F.col("c")).cast("long")})
    known = known.join(lent, "source", "left").withColumn("p", F.least("h", F.coalesce("lent", F.lit(0))))
    known = known.withColumn("total", F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = known.select("c", "source", "h", "p", "total")

    def own(rows: DataFrame, info: DataFrame) -> DataFrame:
        return rows.join(info, "c").filter("i > h").withColumn("pos", F.col("i") - F.col("h") + F.col("p"))

    names = ["c", "pos", "hash0", "hash1", "size", "total"]
    parts = [own(numbered.filter(~long.holds()) if long else numbered, known)]
    if long:
        parts.append(own(numbered.filter(long.holds()), F.broadcast(known.filter(long.holds()))))
    first = numbered.filter(F.col("i") <= BORROWED).withColumnRenamed("c", "source")
    parts.append(first.join(known.filter("h > 0"), "source").filter("i <= h").withColumn("pos", F.col("i")))
    zero = F.lit(0).cast("long")
    parts.append(known.select("c", zero.alias("pos"), zero.alias("hash0"), zero.alias("hash1"), F.lit(0).alias("size"), "total"))
    rows = parts[0].select(*names)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*names))
    return rows


# Units: pieces of a path in flat arrays

UNITS = "c long, band long, total long, sum0 long, sum1 long, keys binary, sizes binary"
_LANES = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _assemble(batches: Batches) -> Batches:
    """Rows sorted by conversation, band and place become one row per unit."""
    held: list[tuple] = []

    def rows(c, band, pos, hashes, sizes, total, edges) -> pa.RecordBatch:
        found = []
        for a, b in zip(edges[:-1], edges[1:]):
            place = pos[a:b].astype(np.uint64)
            steps = [mix(word[a:b] + mix(place * lane)) * (place > 0) for word, lane in zip(hashes, _LANES)]
            keys = np.cumsum(steps, axis=1, dtype=np.uint64)
            last = keys[:, -1].view(np.int64)
            found.append((
                int(c[a]), int(band[a]), int(total[a]), int(last[0]), int(last[1]),
                np.ascontiguousarray(keys).tobytes(), sizes[a:b].astype("<i8").tobytes(),
            ))
        kinds = [pa.int64()] * 5 + [pa.binary()] * 2
        names = [part.split(" ")[0] for part in UNITS.split(", ")]
        columns = zip(*found) if found else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    def columns(parts: list[tuple]) -> tuple:
        return tuple(np.concatenate(x) for x in zip(*parts))

    def done(parts: list[tuple], last: bool) -> tuple[pa.RecordBatch | None, list[tuple]]:
        c, band, pos, hash0, hash1, size, total = columns(parts)
        heads = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (band[1:] != band[:-1])))
        stop = len(c) if last else int(heads[-1])
        edges = [*heads[heads < stop].tolist(), stop]
        batch = rows(c, band, pos, (hash0, hash1), size, total, edges) if stop else None
        return batch, [tuple(x[stop:] for x in (c, band, pos, hash0, hash1, size, total))] if stop < len(c) else []

    for batch in batches:
        values = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)]
        values[3], values[4] = values[3].view(np.uint64), values[4].view(np.uint64)
        if batch.num_rows:
            held.append(tuple(values))
        if sum(len(x[0]) for x in held) > 100_000:
            made, held = done(held, False)
            if made is not None:
                yield made
    if held:
        made, _ = done(held, True)
        yield made


def _units(turns: DataFrame, levels: int) -> DataFrame:
    keys = ["c", "band"]
    rows = turns.withColumn("band", F.floor(F.col("pos") / levels).cast("long"))
    rows = rows.select(*keys, "pos", "hash0", "hash1", F.col("size").cast("long"), "total")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(_assemble, UNITS)


def _shifted(units: DataFrame) -> DataFrame:
    """Units with the digest before them; only later units of long conversations have one."""
    zero = F.lit(0).cast("long")
    first = units.filter("band = 0").withColumns({"before0": zero, "before1": zero})

    def before(batches: Batches) -> Batches:
        c, sums = None, [0, 0]
        for batch in batches:
            out = [[], []]
            ids = batch.column(0).to_pylist()
            for own, a, b in zip(ids, _words(batch.column(2)).tolist(), _words(batch.column(3)).tolist()):
                if own != c:
                    c, sums = own, [0, 0]
                out[0].append(sums[0])
                out[1].append(sums[1])
                sums = [(sums[0] + a) & (1 << 64) - 1, (sums[1] + b) & (1 << 64) - 1]
            more = [_longs(np.array(x, np.uint64)) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], ["c", "band", "before0", "before1"])

    long = units.join(units.filter("band > 0").select("c").distinct(), "c", "left_semi")
    sums = long.select("c", "band", "sum0", "sum1").repartition("c").sortWithinPartitions("c", "band")
    table = sums.mapInArrow(before, "c long, band long, before0 long, before1 long")
    return first.unionByName(units.filter("band > 0").join(table, ["c", "band"]))


class _Paths:
    """The visits of a batch of units: flat arrays over all units of the batch."""

    NAMES = ["c", "band", "total", "before0", "before1", "keys", "sizes"]

    def __init__(self, batch: pa.RecordBatch, levels: int):
        c, band, self.total = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        before = _words(batch.column(3)), _words(batch.column(4))
        raws = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in batch.column(5).to_pylist()]
        self.sizes = np.concatenate([np.frombuffer(x, "<i8") for x in batch.column(6).to_pylist()])
        self.lengths = np.array([x.shape[1] for x in raws])
        self.heads = np.cumsum(self.lengths) - self.lengths
        self.c, self.band = c, band
        self.key = [
            np.concatenate([x[i] for x in raws]) + np.repeat(before[i], self.lengths) for i in range(2)
        ]
        self.parent = [np.append(np.uint64(0), key[:-1]) for key in self.key]
        for i in range(2):
            self.parent[i][self.heads] = before[i]
        inside = np.arange(len(self.sizes)) - np.repeat(self.heads, self.lengths)
        self.rest = np.repeat(self.lengths, self.lengths) - inside
        self.depth = inside + np.repeat(band * levels, self.lengths)

    def each(self, of_units: np.ndarray) -> np.ndarray:
        return np.repeat(of_units, self.lengths)


VISITS = "key0 long, key1 long, parent0 long, parent1 long, depth long, c long, size long, rest long"


def _visits(levels: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _Paths(batch, levels)
            columns = [*p.key, *p.parent, p.depth, p.each(p.c), p.sizes, p.rest]
            names = [part.split(" ")[0] for part in VISITS.split(", ")]
            whole = pa.RecordBatch.from_arrays([_longs(x) for x in columns], names)
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)

    return run


class Crown:
    """The crown's digests and smallest members, sorted for lookups; of checked size."""

    def __init__(self, key0: np.ndarray, key1: np.ndarray, conv: np.ndarray):
        order = np.lexsort((key1, key0))
        self.pairs = np.stack([key0[order], key1[order]], 1).view([("a", np.uint64), ("b", np.uint64)]).ravel()
        self.conv = conv[order]

    def find(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for those that are not in the crown."""
        if not len(self.pairs):
            return np.full(len(key0), -1, np.int64)
        low = np.searchsorted(self.pairs["a"], key0)
        high = np.searchsorted(self.pairs["a"], key0, side="right")
        found = np.full(len(key0), -1, np.int64)
        while True:  # words of equal first lane stand side by side; more than one is rare
            inside = low < high
            if not inside.any():
                return found
            hit = np.flatnonzero(inside)[self.pairs["b"][low[inside]] == key1[inside]]
            found[hit] = low[hit]
            low = low + 1


MARKS = "c long, band long, head0 long, head1 long, ends boolean, end0 long, end1 long"


def _marks(levels: int, crown) -> Callable[[Batches], Batches]:
    """Of every unit the first node below the crown, and whether and where it ends."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _Paths(batch, levels)
            inside = crown.value.find(*p.key) >= 0
            above = np.add.reduceat(inside.astype(np.int64), p.heads)
            head = p.heads + np.minimum(above, p.lengths - 1)
            end = p.heads + p.lengths - 1
            columns = [_longs(x) for x in (p.c, p.band, p.key[0][head], p.key[1][head])]
            columns += [pa.array(p.depth[end] == p.total), _longs(p.key[0][end]), _longs(p.key[1][end])]
            yield pa.RecordBatch.from_arrays(columns, [part.split(" ")[0] for part in MARKS.split(", ")])

    return run


# Shards

NODE = ["key0", "key1", "parent0", "parent1", "depth", "conv", "n_convs", "size", "in_children", "in_leaves", "in_saved"]
DONE = (
    "key0 long, key1 long, parent0 long, parent1 long, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, outside boolean"
)


def _shard(crown) -> Callable[[Batches], Batches]:
    """All subtrees of a task: slots, counts by slot, sums through parent slots."""

    def run(batches: Batches) -> Batches:
        parts = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(NODE))] for batch in batches if batch.num_rows]
        if not parts:
            return
        rows = dict(zip(NODE, (np.ascontiguousarray(np.concatenate(x)).astype(np.int64) for x in zip(*parts))))
        del parts
        key, parent = ([rows[name].view(np.uint64) for name in names] for names in (KEY, PARENT))
        table = SlotTable(*key)
        slot = table.slots(*key)
        flat = {}
        for name in NODE[4:]:
            flat[name] = np.empty(len(slot), np.int64)
            flat[name][slot] = rows[name]
        up = np.empty(len(slot), np.int64)
        outer = [np.empty(len(slot), np.uint64) for _ in PARENT]
        up[slot] = np.where(rows["depth"] > 0, table.slots(*parent), -1)
        for array, values in zip(outer, parent):
            array[slot] = values
        children = flat["in_children"] + np.bincount(up[up >= 0], minlength=len(slot))
        leaves = flat["in_leaves"] + (children == 0)
        saved = flat["in_saved"] + (flat["n_convs"] - 1) * flat["size"]
        order = np.argsort(-flat["depth"], kind="stable")
        edges = np.flatnonzero(np.diff(flat["depth"][order], prepend=-2, append=-2))
        for a, b in zip(edges[:-1], edges[1:]):
            level = order[a:b]
            level = level[up[level] >= 0]
            np.add.at(leaves, up[level], leaves[level])
            np.add.at(saved, up[level], saved[level])
        out = up < 0
        above = crown.value.find(*outer) if crown else np.full(len(slot), -1)
        known = np.where(out, crown.value.conv[above] if crown and len(crown.value.conv) else 0, flat["conv"][up])
        unknown = out & (above < 0) | (flat["depth"] == 0)
        columns = [_longs(x) for x in (table.key0, table.key1, *outer, flat["depth"], flat["conv"])]
        columns.append(pa.array(known, pa.int64(), mask=unknown))
        columns += [_longs(x) for x in (flat["n_convs"], children, leaves, saved)]
        columns.append(pa.array(out & (flat["depth"] > 0)))
        whole = pa.RecordBatch.from_arrays(columns, [part.split(" ")[0] for part in DONE.split(", ")])
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)

    return run


def _below(done: DataFrame) -> DataFrame:
    """What the subtrees of ``done`` add to each parent outside."""
    return done.filter("outside").groupBy(*PARENT, (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved")
    ).withColumnsRenamed(dict(zip(PARENT, KEY)))


def _added(one: DataFrame, two: DataFrame) -> DataFrame:
    names = NODE[-3:]
    return one.unionByName(two).groupBy(*KEY, "depth").agg(*[F.sum(name).alias(name) for name in names])


def _with_below(nodes: DataFrame, below: DataFrame | None) -> DataFrame:
    names = NODE[-3:]
    if below is None:
        return nodes.withColumns({name: F.lit(0).cast("long") for name in names})
    joined = nodes.join(below, [*KEY, "depth"], "left")
    return joined.withColumns({name: F.coalesce(name, F.lit(0)) for name in names})


def _ends(marks: DataFrame, chunk: int) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and joined by commas."""

    def join(batches: Batches) -> Batches:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            columns = [[key[0]], [key[1]], [ids[0]], [",".join(map(str, ids))]]
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["key0", "key1", "first", "ids"])

        for batch in batches:
            made = []
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != (a, b) or len(ids) == chunk:
                    if ids:
                        made.append(row())
                    key, ids = (a, b), []
                ids.append(c)
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
        if ids:
            yield row()

    def digest(batches: Batches) -> Batches:
        key, state, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key == (a, b):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield _hashes(done)
                done = []
        if key is not None:
            yield _hashes([(*key, state.hexdigest())])

    def _hashes(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["key0", "key1", "ends_sha256"])

    ends = marks.filter("ends").select(F.col("end0").alias("key0"), F.col("end1").alias("key1"), "c")
    texts = ends.repartitionByRange("key0", "key1", "c").sortWithinPartitions("key0", "key1", "c").mapInArrow(
        join, "key0 long, key1 long, first long, ids string"
    )
    ordered = texts.repartition("key0", "key1").sortWithinPartitions("key0", "key1", "first")
    return ordered.select("key0", "key1", "ids").mapInArrow(digest, "key0 long, key1 long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, rebuild: Rebuild = Rebuild(), conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", levels: int = 65_536, limit: int = 1 << 12, most: int = 1 << 20,
    chunk: int = 4096, rows_a_shard: int = 500_000, **limits: int,
) -> DataFrame:
    """All nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes of the turns that members after
    the first repeat, over the subtree) and ``ends_sha256``.

    ``limits`` are those of ``LongGroups``.
    """
    spark = conversations.sparkSession
    steps = Steps(spark, "trie")
    turns = rebuilt_turns(conversations, rebuild, conv_id, turn, role, text, **limits)
    units = steps.saved(_units(turns, levels), "units")
    bands = units.agg((F.coalesce(F.max("band"), F.lit(-1)) + 1).alias("n")).first()["n"]
    zero = F.lit(0).cast("long")
    paths = _shifted(units) if bands > 1 else units.withColumns({"before0": zero, "before1": zero})
    paths = paths.select(*_Paths.NAMES)

    visits = paths.mapInArrow(_visits(levels), VISITS)
    same = [*PARENT, "size"]
    nodes = visits.groupBy(*KEY, "depth").agg(
        F.min("c").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum("rest").alias("weight"),
        *[F.min(name).alias(name) for name in same], *[F.max(name).alias(f"{name}_max") for name in same],
    )
    differ = F.lit(False)
    for name in same:
        differ = differ | (F.col(name) != F.col(f"{name}_max"))
    checked = F.when(differ, F.raise_error(F.lit("two prefixes have one digest"))).otherwise(F.col("n_convs"))
    nodes = nodes.withColumn("n_convs", checked.cast("long")).drop(*[f"{name}_max" for name in same])
    nodes = steps.saved(nodes.withColumn("band", F.floor(F.col("depth") / levels).cast("long")), "nodes")

    doubled = [limit << j for j in range(41)]
    sizes = nodes.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n_convs"), F.lit(0)),
        *[F.count(F.when(F.col("weight") > x, 1)) for x in doubled],
    ).first()
    fits = [x for x, n in zip(doubled, sizes[2:]) if n <= most and x * 4096 >= sizes[1]]
    in_crown = F.col("weight") > (fits[0] if fits else doubled[-1])
    table = nodes.filter(in_crown).select(*KEY, "conv").toArrow().combine_chunks()
    crown = spark.sparkContext.broadcast(Crown(
        *[_words(table.column(i).combine_chunks()) for i in range(2)], table.column(2).to_numpy().astype(np.int64)
    ))
    marks = steps.saved(paths.mapInArrow(_marks(levels, crown), MARKS), "marks")

    light = nodes.filter(~in_crown).join(marks.select(F.col("c").alias("conv"), "band", "head0", "head1"), ["conv", "band"])
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes[0] // rows_a_shard)
    found, below = [], None
    for band in range(bands - 1, -1, -1):
        own = _with_below(light.filter(F.col("band") == band), below)
        low = own.repartition(shards, "head0", "head1").select(*NODE).mapInArrow(_shard(crown), DONE)
        low = steps.saved(low, f"light-{band}")
        upper = nodes.filter(in_crown & (F.col("band") == band))
        sums = _below(low) if below is None else _added(_below(low), below)
        top = _with_below(upper, sums).select(*NODE).repartition(1).mapInArrow(_shard(crown), DONE)
        top = steps.saved(top, f"crown-{band}")
        found += [low, top]
        below = _below(low.unionByName(top)).filter(F.col("depth") < band * levels) if band else None
    if not found:
        return spark.createDataFrame([], RESULT)
    done = found[0]
    for part in found[1:]:
        done = done.unionByName(part)
    if bands > 1:  # parents in the units above
        parents = nodes.filter((F.col("depth") + 1) % levels == 0).select(
            F.col("key0").alias("parent0"), F.col("key1").alias("parent1"),
            (F.col("depth") + 1).alias("depth"), F.col("conv").alias("above"),
        )
        done = done.join(parents, [*PARENT, "depth"], "left")
        done = done.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    done = done.join(_ends(marks, chunk), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return done.select(*names, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
