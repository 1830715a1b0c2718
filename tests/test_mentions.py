from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from answerlog.operators import mentions
from tests.conftest import rows_of


def test_mentions_count_every_occurrence(spark, make_log, empty_log):
    texts = ["Ana banana", "BANANA", "an", "", None, "é-Café"]
    log = make_log([{"model": ["m", ""][i % 2], "timestamp": f"2024-01-0{1 + i // 3}", "answer_text": t} for i, t in enumerate(texts)])
    terms = spark.createDataFrame([("ana",), ("An",), ("nan",), ("",), (None,), ("ANA",), ("café",)], "term string")
    got = {(r["model"], r["period"][8:10], r["term"]): (r["answers"], r["mentioning"], r["mentions"], r["share"])
           for r in rows_of(mentions.mention_share(log, terms, "day"))}
    # Overlapping: "ana" is in "banana" twice, "an" is inside "ana" and counts too.
    assert got[("m", "01", "ana")] == (2, 1, 3, 0.5) and got[("m", "01", "an")] == (2, 2, 4, 1.0)
    assert got[("m", "01", "nan")] == (2, 1, 1, 0.5) and got[("unknown", "01", "ana")] == (1, 1, 2, 1.0)
    assert got[("unknown", "02", "café")] == (1, 1, 1, 1.0) and ("m", "02", "ana") not in got
    assert mentions.mention_share(log, terms.limit(0)).count() == 0
    assert mentions.mention_share(empty_log, terms).count() == 0


def test_citation_shares(spark):
    links = [("a", "https://www.x.org/1"), ("a", "https://x.org/2"), ("a", "nothing"), (None, "http://y.org:80/")]
    got = {(r["model"], r["domain"]): (r["citations"], r["share"]) for r in
           rows_of(mentions.domain_citation_share(spark.createDataFrame(links, "model string, url string")))}
    assert got[("a", "x.org")] == (2, pytest.approx(2 / 3)) and got[("a", "")][0] == 1
    assert got[("unknown", "y.org:80")] == (1, 1.0)


def test_changes_of_a_hot_prompt_equal_the_loop(spark, make_log):
    rng, rows = random.Random(3), []
    for i in range(900):
        hot = i % 3 == 0
        rows.append({
            "query": "hot" if hot else f"p{rng.randint(0, 40)}", "model": rng.choice(["m", None, "n"]) if not hot else "m",
            "timestamp": f"2024-0{rng.randint(1, 3)}-0{rng.randint(1, 9)}T0{rng.randint(0, 9)}:00:00",
            "answer_text": rng.choice(["a", "a", "a", "b", "", None]),
        })
    log = make_log(rows)
    want, last = collections.defaultdict(lambda: [0, 0]), {}
    for number, r in sorted(enumerate(rows, 1), key=lambda x: (x[1]["timestamp"], x[0])):
        if not r["answer_text"]:
            continue
        key = (r["query"], r["model"] or "unknown")
        if key in last:
            cell = want[(*key, r["timestamp"][:7] + "-01")]
            cell[0] += 1
            cell[1] += last[key] != r["answer_text"]
        last[key] = r["answer_text"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["query"], r["model"], r["period"]): [r["compared"], r["changed"]] for r in rows_of(mentions.answer_change(log))}
        before = mentions.with_previous(log.select("query", "id"), ["query"], ["id"], "id", "before")
        same = log.select("query", "id", F.lag("id").over(mentions.Window.partitionBy("query").orderBy("id")).alias("before"))
        assert before.exceptAll(same).count() == 0 and before.count() == 900
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dict(want)
