from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from answerlog.operators import dedup, similarity
from answerlog.session import join_groups, with_dense_index, with_number
from pyspark.sql import functions as F
from tests.conftest import one, rows_of


@pytest.fixture(scope="module")
def log(make_log):
    base = {"timestamp": "2024-01-01", "execution_time_seconds": 9.0}
    return make_log(
        [
            {**base, "model": "m1"},
            {**base, "model": "m1", "timestamp": "2024-01-02", "success": False},
            {**base, "model": "m2"},
            {**base, "query": "U", "model": "m1"},
            {**base, "query": "p", "model": None, "execution_time_seconds": 2.0},
            {**base, "query": "p", "model": None},
            {**base, "query": "p", "model": None, "execution_time_seconds": None, "timestamp": "2023-12-01"},
        ]
    )


def ids(df):
    return sorted(row["id"] for row in df.select("id").collect())


def test_exact_duplicates(log):
    assert {(r["query_text"], r["count"]) for r in rows_of(dedup.duplicate_queries(log))} == {("P", 3), ("p", 3)}
    folded = one(dedup.duplicate_groups(log, ignore_case=True))
    assert (folded["group_query"], folded["count"], folded["model_count"]) == ("p", 6, 2)
    members = rows_of(dedup.duplicate_group_members(log))
    assert sorted(r["id"] for r in members) == [1, 2, 3, 5, 6, 7]
    models = {(r["group_query"], r["model"]) for r in rows_of(dedup.duplicate_group_models(log))}
    assert models == {("P", "m1"), ("P", "m2")}


def test_keep_policies(log):
    assert ids(dedup.deduplicate(log, "latest")) == [2, 3, 4, 6]
    assert ids(dedup.deduplicate(log, "earliest")) == [1, 3, 4, 7]
    assert ids(dedup.deduplicate(log, "best")) == [1, 3, 4, 7]
    assert ids(dedup.removable(log, "latest")) == [1, 5, 7]
    assert one(dedup.removal_report(log)) == {"kept_count": 4, "removed_count": 3}
    with pytest.raises(ValueError):
        dedup.keepers(log, "any")


def test_triplets(log):
    assert ids(dedup.deduplicate_triplets(log)) == [1, 2, 3, 4, 5, 7]
    assert ids(dedup.removable_triplets(log)) == [6]


def test_hot_group_is_whole_and_not_shuffled(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k")
    )
    groups = rows.groupBy("k").count()
    joined = join_groups(rows, groups, ["k"], parts=10)
    assert joined.count() == 3000
    counts = {r["k"]: r["count"] for r in joined.select("k", "count").distinct().collect()}
    assert counts["hot"] == 1000 and counts[None] == 1000 and counts["1"] == 1


def test_dense_index(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    numbered = with_dense_index(rows, [F.desc("v")], "n", 5)
    assert {(r["v"], r["n"]) for r in numbered.collect()} == {(v, 5 + 999 - v) for v in range(1000)}


def test_numbers_of_wide_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("text"))
    for descending in (False, True):
        got = with_number(rows, ["v"], "n", 5, descending).collect()
        assert {(r["v"], r["n"]) for r in got} == {(v, 5 + (999 - v if descending else v)) for v in range(1000)}
    # Equal and missing keys keep a number each, missing ones at the small end.
    keys = [(None, None), (None, 1), (1, None), (1, 2), (1, 2), (None, None), (3, 0)]
    odd = spark.createDataFrame(keys, "a long, b long").repartition(3)
    got = sorted((r["n"], r["a"], r["b"]) for r in with_number(odd, ["a", "b"], "n").collect())
    assert [n for n, _, _ in got] == list(range(7))
    assert [k[1:] for k in got] == sorted(keys, key=lambda k: tuple((x is not None, x or 0) for x in k))
    got = sorted((r["n"], r["a"], r["b"]) for r in with_number(odd, ["a", "b"], "n", descending=True).collect())
    assert [k[1:] for k in got][::-1] == sorted(keys, key=lambda k: tuple((x is not None, x or 0) for x in k))
    assert with_number(odd.limit(0), ["a"], "n").collect() == []


def test_numbered_rows_stay_where_they_are(spark):
    rows = spark.range(2000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 70).alias("w"))
    rows = rows.repartition(5, "w").withColumn("at", F.spark_partition_id())
    texts = spark.range(70).select(F.col("id").alias("w"), F.repeat(F.lit("x"), 9).alias("text"))
    got = with_number(rows.join(texts, "w", "left"), ["v", "w"], "n", 1)
    got = got.withColumn("now", F.spark_partition_id()).collect()
    assert all(r["at"] == r["now"] for r in got) and len({r["now"] for r in got}) > 1
    got = sorted(got, key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(1, 2001))
    assert [(r["v"], r["w"]) for r in got] == sorted((r["v"], r["w"]) for r in got)


def test_rows_that_change_are_not_numbered(spark):
    chance = F.udf(lambda: random.random(), "double").asNondeterministic()
    changing = with_number(spark.range(100).withColumn("v", chance()), ["v"], "n")
    with pytest.raises(Exception, match="changed between two readings"):
        changing.collect()


# -- near duplicates -------------------------------------------------------------------


def positional(a: str, b: str) -> float:
    a, b = a.lower(), b.lower()
    if not a or not b:
        return float(a == b)
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


def sequence(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def greedy(queries, score, threshold):
    leaders, pairs = [], set()
    for query in sorted(queries):
        for leader in leaders:
            if score(leader, query) >= threshold:
                pairs.add((leader, query, round(score(leader, query), 9)))
                break
        else:
            leaders.append(query)
    return pairs


def prompts(seed: int, count: int, alphabet: str, shortest: int, longest: int, families: int):
    rnd = random.Random(seed)
    bases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(shortest, longest))) for _ in range(families)]
    found = {""}
    while len(found) < count:
        text = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4)):
            place, kind = rnd.randrange(len(text) + 1), rnd.random()
            if kind < 0.5 and place < len(text):
                text[place] = rnd.choice(alphabet)
            elif kind < 0.75:
                text.insert(place, rnd.choice(alphabet))
            elif len(text) > 1:
                del text[min(place, len(text) - 1)]
        found.add("".join(text))
    return sorted(found)


def found_pairs(df):
    return {(r["query_text"], r["similar_query"], round(r["similarity"], 9)) for r in rows_of(df)}


FORCED = {"hot": 8, "budget": 400, "in_one_task": 10}


@pytest.mark.parametrize("threshold, options", [(0.6, {}), (0.8, {}), (0.8, FORCED), (0.9, FORCED)])
def test_positional_groups_equal_brute_force(make_log, threshold, options):
    queries = prompts(11, 90, "abAB cé😀", 4, 24, 7)
    log = make_log([{"query": q} for q in queries + queries[:9]])
    want = greedy(queries, positional, threshold)
    assert want
    assert found_pairs(similarity.similar_queries(log, threshold, **options)) == want


@pytest.mark.parametrize("threshold, options", [(0.8, {}), (0.9, FORCED)])
def test_sequence_groups_equal_brute_force(make_log, threshold, options):
    queries = prompts(12, 90, "abcde ", 3, 40, 7)
    log = make_log([{"query": q} for q in queries])
    want = greedy(queries, sequence, threshold)
    assert want
    assert found_pairs(similarity.sequence_similar(log, threshold, **options)) == want


def test_long_prompts_use_the_same_ratio(make_log):
    """From 200 characters on the ratio ignores very frequent characters."""
    rnd = random.Random(5)
    base = "".join(rnd.choice("ab cdefgh") for _ in range(230))
    queries = {base} | {base[:i] + "xyz" + base[i + 5 :] for i in range(0, 200, 40)}
    log = make_log([{"query": q} for q in queries])
    assert found_pairs(similarity.sequence_similar(log)) == greedy(queries, sequence, 0.9)


def test_template_cluster_gives_one_row_per_member(make_log):
    """A third of the prompts are copies of one template that differ in their end."""
    queries = [f"show the current weather for station {i:03d}" for i in range(150)]
    queries += prompts(13, 200, "abcdefghij ", 20, 30, 200)
    log = make_log([{"query": q} for q in queries])
    got = rows_of(similarity.fuzzy_groups(log, 0.9, hot=50, budget=5000, in_one_task=100))
    assert {(r["query_text"], r["similar_query"]) for r in got} == {
        pair[:2] for pair in greedy(set(queries), positional, 0.9)
    }
    cluster = [r for r in got if r["query_text"] == queries[0]]
    assert len(cluster) == 149 and {r["count"] for r in cluster} == {150}


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_prompts_of_one_template_equal_brute_force(make_log, threshold):
    rnd = random.Random(8)

    def word(size):
        return "".join(rnd.choice("abcdefgh") for _ in range(size))

    queries = [f"tell me all about {word(10)} in the {word(rnd.randint(6, 9))} of {i % 7}" for i in range(150)]
    queries += [q[:25] + "xy" + q[27:] for q in queries[:30]] + [f"list what {word(14)} has" for _ in range(40)]
    queries = sorted(set(queries))
    log = make_log([{"query": q} for q in queries])
    want = greedy(queries, positional, threshold)
    assert found_pairs(similarity.similar_queries(log, threshold, hot=10)) == want
    assert len(want) >= 20


def test_similarity_arguments(diverse, empty_log):
    for call in (
        lambda: similarity.similar_queries(diverse, -0.1),
        lambda: similarity.similar_queries(diverse, 1.0),
        lambda: similarity.sequence_similar(diverse, 0.5),
    ):
        with pytest.raises(ValueError):
            call()
    everything = found_pairs(similarity.similar_queries(diverse, 0.0))
    assert everything == greedy({f"prompt {i}" for i in range(7)}, positional, 0.0)
    exact = rows_of(similarity.fuzzy_groups(diverse, 1.0))
    assert len(exact) == 7 and {r["similar_query"] for r in exact} == {None}
    assert rows_of(similarity.similar_queries(empty_log)) == []
    assert rows_of(similarity.sequence_similar(empty_log)) == []
