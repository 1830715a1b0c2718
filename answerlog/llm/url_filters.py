"""Url filters: base rules, then a Bloom filter cascade over listed hosts.

A cascade decides exactly whether a key of a known universe is listed, without a join:
level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets through,
level 3 the listed keys that level 2 lets through, and so on until nothing passes
wrongly. The universe is every key of the corpus: the hosts of all urls and their parent
domains. Keys are spread over shards by hash, a shard holds about ``shard_keys`` distinct
keys however large the corpus is, and its levels are built in one task.

The levels take a few bits per listed key. Up to ``limit`` bytes (measured, not assumed)
they are broadcast and every url is tested where it lies; beyond that the distinct hosts
meet the levels shard by shard, and the result is joined to the urls by host.

Defined results: a null url, or one without "://", has an empty host and path, fits no
rule, has no key and is allowed. A host longer than 253 bytes is no DNS name; it is its
own only key. Repeated urls are judged alike; other columns pass through; an empty table
or an empty list gives no listed key; null or empty listed keys are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlog.llm.textkit import mix
from answerlog.session import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = "shard long, level int, n_hash int, n_bits long, bits binary"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://", A-Z lower-cased) and path of a url, both '' without one."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits, and its action; null where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        name = F.when(fits, F.lit(rule)).otherwise(name)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def host_keys(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    parents = F.transform(
        F.sequence(F.lit(1), count - 1), lambda i: F.array_join(F.slice(labels, i, count), ".")
    )
    whole = (F.octet_length(host) > 253) | (count < 2)
    return F.when(host == "", F.array().cast("array<string>")).when(whole, F.array(host)).otherwise(parents)


def _positions(one: np.ndarray, two: np.ndarray, level: int, n_hash: int, n_bits: int) -> np.ndarray:
    salt = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
    a, b = mix(one ^ salt), mix(two + salt) | np.uint64(1)
    steps = np.arange(n_hash, dtype=np.uint64)[:, None]
    return (a + steps * b) % np.uint64(n_bits)


def _passes(bits: np.ndarray, one, two, level: int, n_hash: int, n_bits: int) -> np.ndarray:
    at = _positions(one, two, level, n_hash, n_bits)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _build(shard: int, one: np.ndarray, two: np.ndarray, listed: np.ndarray) -> list[tuple]:
    """Levels of one shard's cascade."""
    into, out = (one[listed], two[listed]), (one[~listed], two[~listed])
    levels: list[tuple] = []
    while len(into[0]):
        if len(levels) == 100:
            raise RuntimeError("two keys share both hashes")
        ratio = len(into[0]) / max(1, len(out[0]))
        rate = min(0.5, ratio * math.sqrt(0.5)) if not levels else 0.5
        n_hash = max(1, round(-math.log2(rate)))
        n_bits = max(64, math.ceil(len(into[0]) * -math.log2(rate) / math.log(2)))
        bits, level = np.zeros((n_bits + 7) // 8, np.uint8), len(levels)
        at = _positions(*into, level, n_hash, n_bits).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        levels.append((shard, level, n_hash, n_bits, bits.tobytes()))
        wrong = _passes(bits, *out, level, n_hash, n_bits)
        into, out = (out[0][wrong], out[1][wrong]), into
    return levels


def _listed(levels: list[tuple], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed, by one shard's cascade."""
    result = np.zeros(len(one), bool)
    open_ = np.arange(len(one))
    for level, n_hash, n_bits, bits in levels:
        through = _passes(np.frombuffer(bits, np.uint8), one[open_], two[open_], level, n_hash, n_bits)
        result[open_[~through]] = level % 2 == 1
        open_ = open_[through]
    result[open_] = len(levels) % 2 == 1
    return result


def with_hashes(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumns(
        {"one": F.xxhash64("key"), "two": F.xxhash64("key", F.lit(1))}
    ).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards)))


def build_cascade(universe: DataFrame, listed: DataFrame, shard_keys: int) -> tuple[DataFrame, int]:
    """Levels of all shards, and their number. Both inputs have a column ``key``."""
    keys = universe.select("key", F.lit(0).alias("is_listed")).unionByName(
        listed.select("key", F.lit(1).alias("is_listed"))
    )
    # Listed keys outside the corpus are never asked for and take no bits.
    keys = keys.groupBy("key").agg(
        F.max("is_listed").alias("is_listed"), F.min("is_listed").alias("is_foreign")
    )
    keys = pin(keys.filter("is_foreign = 0").select("key", (F.col("is_listed") == 1).alias("is_listed")))
    shards = max(1, math.ceil(keys.count() / shard_keys))

    def build(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("one", "two"))
        rows = _build(int(group[0]), one, two, pdf["is_listed"].to_numpy(bool))
        return pd.DataFrame(rows, columns=["shard", "level", "n_hash", "n_bits", "bits"])

    hashed = with_hashes(keys, shards).select("shard", "one", "two", "is_listed")
    return pin(hashed.groupBy("shard").applyInPandas(build, LEVELS)), shards


def url_filters(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url",
    shard_keys: int = 500_000, limit: int = 32 << 20,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``listed_key`` and ``verdict`` (input
    columns of these names are replaced). ``listed`` has one string column: blocked domains,
    each with all its subdomains. A rule decides where one fits, else the list."""
    listed = listed.select(F.col(listed.columns[0]).alias("key")).filter("key <> ''")
    host, path = host_and_path(F.col(url))
    parts = pages.select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "listed_key", "verdict")],
        host.alias("host"), path.alias("path"),
    )
    hosts = pages.select(host.alias("host")).filter("host <> ''").distinct()
    universe = hosts.select(F.explode(host_keys(F.col("host"))).alias("key")).distinct()
    levels, shards = build_cascade(universe, listed, shard_keys)
    size = levels.agg(F.sum(F.length("bits"))).first()[0] or 0
    if size <= limit:
        judged = parts.withColumn("listed_key", _probe(levels, shards, F.col("host")))
    else:
        judged = parts.join(_by_shard(hosts, levels, shards), "host", "left")
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed_key").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    order = [c for c in parts.columns] + ["rule", "listed_key", "verdict"]
    return judged.withColumns({"rule": name, "verdict": F.coalesce(action, by_list)}).select(*order)


def _probe(levels: DataFrame, shards: int, host: Column) -> Column:
    """Longest listed key of a host, tested against broadcast levels of a checked size."""
    cascade: dict[int, list[tuple]] = {}
    for row in levels.orderBy("shard", "level").collect():
        cascade.setdefault(row["shard"], []).append((row["level"], row["n_hash"], row["n_bits"], bytes(row["bits"])))
    shared = levels.sparkSession.sparkContext.broadcast(cascade)

    def first_listed(one: pa.Array, two: pa.Array, shard: pa.Array) -> pa.Array:
        a, b = (x.values.to_numpy().view(np.uint64) for x in (one, two))
        at, starts = shard.values.to_numpy(), one.offsets.to_numpy()
        found = np.zeros(len(a), bool)
        for number in np.unique(at):
            if number in shared.value:
                mine = np.flatnonzero(at == number)
                found[mine] = _listed(shared.value[number], a[mine], b[mine])
        hits = np.append(np.flatnonzero(found), len(a))
        next_hit = hits[np.searchsorted(hits, starts[:-1])]
        place = np.where(next_hit < starts[1:], next_hit - starts[:-1] + 1, 0)
        return pa.array(place.astype(np.int32))

    keys = host_keys(host)
    place = F.arrow_udf(first_listed, "int")(
        F.transform(keys, lambda k: F.xxhash64(k)),
        F.transform(keys, lambda k: F.xxhash64(k, F.lit(1))),
        F.transform(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(2)), F.lit(shards))),
    )
    return F.try_element_at(keys, F.nullif(place, F.lit(0)))


def _by_shard(hosts: DataFrame, levels: DataFrame, shards: int) -> DataFrame:
    """Longest listed key per host, with keys and levels meeting shard by shard."""
    rows = hosts.select("host", F.posexplode(host_keys(F.col("host"))).alias("place", "key"))

    def test(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(pdf):
            return pdf.iloc[:0][["host", "place", "key"]]
        own = own.sort_values("level")
        steps = list(own[["level", "n_hash", "n_bits", "bits"]].itertuples(index=False, name=None))
        one, two = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("one", "two"))
        return pdf[_listed(steps, one, two)][["host", "place", "key"]]

    hits = (
        with_hashes(rows, shards).groupBy("shard").cogroup(levels.groupBy("shard"))
        .applyInPandas(test, "host string, place int, key string")
    )
    best = hits.groupBy("host").agg(F.min_by("key", "place").alias("listed_key"))
    return hosts.join(best, "host", "left")
