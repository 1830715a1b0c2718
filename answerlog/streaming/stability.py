"""Stability checks on a stream, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from answerlog.operators.stability import MIN_CHARS, PARTS, STABLE_CHECKS, check_limits, digests

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "seqs binary, sizes binary, digests binary"


class _Part(StatefulProcessor):
    """The checks of one part of an entity, sorted by number: numbers, lengths and hashes as
    three arrays. A check that comes late is merged by its number, one that comes again
    takes the place of its copy."""

    def __init__(self, threshold: int, min_chars: int, max_wait_ms: int | None):
        self.threshold, self.min_chars, self.max_wait_ms = threshold, min_chars, max_wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.checks = handle.getValueState("checks", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        seqs, sizes = (arrived[name].to_numpy(np.int64) for name in ("seq", "size"))
        texts = arrived["digest"].to_numpy().astype("S32")
        known = self.checks.get()
        if known is not None:
            seqs = np.append(np.frombuffer(known[0], np.int64), seqs)
            sizes = np.append(np.frombuffer(known[1], np.int64), sizes)
            texts = np.append(np.frombuffer(known[2], "S32"), texts)
        order = np.argsort(seqs, kind="stable")
        seqs, sizes, texts = seqs[order], sizes[order], texts[order]
        last = np.append(seqs[1:] != seqs[:-1], True)
        seqs, sizes, texts = seqs[last], sizes[last], texts[last]
        self.checks.update((seqs.tobytes(), sizes.tobytes(), texts.tobytes()))
        if self.max_wait_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.max_wait_ms)
        yield pd.DataFrame([self.report(key, seqs, sizes, texts)], columns=[x.split(" ")[0] for x in PARTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.checks.clear()
        return iter([])

    def report(self, key, seqs, sizes, texts) -> tuple:
        k = self.threshold
        same = (texts[1:] == texts[:-1]) & (sizes[1:] == sizes[:-1]) & (sizes[1:] >= self.min_chars)
        runs = np.convolve(same, np.ones(k, np.int64), "valid") if len(same) >= k else np.empty(0, np.int64)
        hits = np.flatnonzero(runs == k) + k
        found = (int(seqs[hits[0]]), int(sizes[hits[0]])) if len(hits) else (None, None)

        def listed(part: slice) -> list[dict]:
            values = seqs[part].tolist(), sizes[part].tolist(), texts[part].tolist()
            return [{"seq": a, "size": b, "digest": c.decode()} for a, b, c in zip(*values)]

        return (*key, len(seqs), *found, listed(slice(0, k)), listed(slice(-k, None)))


def stability_stream(
    snapshots: DataFrame,
    threshold: int = STABLE_CHECKS,
    min_chars: int = MIN_CHARS,
    max_wait_ms: int | None = None,
    part: int = 4096,
) -> DataFrame:
    """What is known of each part of an entity's checks, whenever that changes.

    A part holds the checks of ``part`` consecutive numbers, so an entity with most of the
    checks is spread over many keys, none of which can grow. The rows (append mode) are
    reports, read by :func:`answerlog.operators.stability.stability_of_parts`, which equals
    the batch form however the checks were cut into micro-batches and in whatever order
    they came. With ``max_wait_ms`` the state of a part ends when nothing came for that
    long; what comes later for it is left out of account then. A query with timers goes on
    until it is stopped, also with the trigger ``availableNow``.

    Keyed state of this kind is kept in RocksDB; the session is set to it.
    """
    check_limits(threshold, min_chars)
    spark = snapshots.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS_DB:
        spark.conf.set(PROVIDER, ROCKS_DB)
    checks = digests(snapshots).withColumn("part", F.floor(F.col("seq") / part).cast("long"))
    return checks.groupBy("entity_id", "part").transformWithStateInPandas(
        _Part(threshold, min_chars, max_wait_ms), PARTS, "append",
        "none" if max_wait_ms is None else "processingTime",
    )
