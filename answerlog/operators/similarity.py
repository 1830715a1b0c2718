"""Near-duplicate prompts: groups around leaders, found without comparing all pairs.

Prompts are taken in ascending order. A prompt that is similar to no leader so far becomes
a leader; any other belongs to the first leader it is similar to. The result has one row
per member, so a cluster of many near copies gives as many rows, not their square.

Candidates come from signatures that any two similar prompts must share (a pigeonhole
argument, so none is missed); candidates are always verified. Signatures shared by many
prompts are refined by a second one under them where that pays. Prompts are settled in rounds over growing
prefixes of the order: the members that a round's leaders find, leave before they can be
paired with each other, and a round's prefix is chosen so that its candidates fit a budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlog.functions.scalars import positional_similarity
from answerlog.operators.dedup import duplicate_queries
from answerlog.session import join_groups, pin, with_dense_index

EPS = 1e-9
HOT = 200
MAX_DEPTH = 3
SPREAD = 64
IN_ONE_TASK = 1_000_000
FIRST_ROLE, SECOND_ROLE = 1, 2


def sequence_ratio_of(threshold: float = 0.0):
    """Vectorised difflib ratio; pairs that cannot reach the threshold give 0."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = SequenceMatcher(None)
        for left, right in batches:
            shown = []
            for first, second in zip(left, right):
                matcher.set_seqs(first, second)
                reachable = (
                    matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold
                )
                shown.append(matcher.ratio() if reachable else 0.0)
            yield pd.Series(shown, dtype="float64")

    return ratio


# Characters are counted in buckets by hash; a count is a run of as many bits, at most eight.
WORDS, BUCKETS_PER_WORD, MOST = 4, 7, 8


def character_bag(text: Column) -> Column:
    """Counts of a text's characters as bits of ``WORDS`` numbers, and what went beyond."""
    buckets = WORDS * BUCKETS_PER_WORD
    places = F.transform(F.split(text, ""), lambda char: F.pmod(F.hash(char), F.lit(buckets)))

    def count(bucket: int) -> Column:
        return F.size(F.filter(places, lambda place: place == bucket))

    runs = F.array(*[F.lit((1 << n) - 1).cast("long") for n in range(MOST + 1)])
    words, beyond = [], F.lit(0).cast("long")
    for word in range(WORDS):
        value = F.lit(0).cast("long")
        for slot in range(BUCKETS_PER_WORD):
            found = count(word * BUCKETS_PER_WORD + slot)
            run = F.get(runs, F.least(found, F.lit(MOST)))
            value = value + run * F.lit(1 << (MOST * slot)).cast("long")
            beyond = beyond + F.greatest(found - MOST, F.lit(0))
        words.append(value)
    return F.array(*words, beyond)


def common_characters(left: Column, right: Column) -> Column:
    """Upper bound of the characters two texts have in common, from their bags."""
    common = F.least(left[WORDS], right[WORDS])
    for word in range(WORDS):
        common = common + F.bit_count(left[word].bitwiseAND(right[word]))
    return common


# -- signatures ------------------------------------------------------------------------


def _floor(value: Column) -> Column:
    return F.floor(value + EPS).cast("int")


def _ceil(value: Column) -> Column:
    return F.ceil(value - EPS).cast("int")


class Positional:
    """Equal characters at equal places, in terms of the longer prompt.

    Of a shorter prompt of length l at most k = (1-t)l places differ, so of its k+1 or
    more pieces of width l/(k+1) one is equal in both. A prompt of length L gives the
    pieces for every length l from tL to L it may be compared with; these have few widths.
    A refined signature adds a piece of the text that is left without the first piece.

    Prompts made from one template share most pieces without being similar. So before a
    signature is refined, the places at which all its prompts agree are left out of them:
    what differs lies elsewhere, and the pieces are cut from places that tell prompts apart.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def start(self, nodes: DataFrame) -> DataFrame:
        empty = nodes.filter(F.length("text") > 0).withColumns(
            {
                "rest": F.col("text"),
                "bag": F.lit(None).cast("array<bigint>"),
                "sig": F.lit(0).cast("long"),
                "pos": F.lit(0),
                "role": F.lit(FIRST_ROLE | SECOND_ROLE),
            }
        )
        return self.refine(empty)

    def refine(self, rows: DataFrame) -> DataFrame:
        size = F.length("text")
        gone = size - F.length("rest")
        lengths = F.sequence(F.greatest(_ceil(size * self.threshold), F.lit(1)), size)

        def width(length: Column) -> Column:
            differing = _floor(length * (1 - self.threshold))
            return F.greatest(F.floor((length - gone) / (differing + 1)).cast("int"), F.lit(0))

        wide = rows.drop("place").withColumn("width", F.explode(F.array_distinct(F.transform(lengths, width))))
        # Width 0: too little text is left, the signature cannot be refined.
        last = F.floor(F.length("rest") / F.greatest("width", F.lit(1))).cast("int") - 1
        places = F.when(F.col("width") == 0, F.array(F.lit(0))).when(
            last >= 0, F.sequence(F.lit(0), last)
        )
        pieces = wide.withColumn("place", F.explode(places))
        start = F.col("place") * F.col("width")
        piece = F.substr("rest", start + 1, F.col("width"))
        left = F.concat(
            F.substr("rest", F.lit(1), start), F.substr("rest", start + F.col("width") + 1)
        )
        return pieces.withColumns(
            {"sig": F.xxhash64("sig", "width", "place", piece), "rest": left}
        )  # ``width`` and ``place`` stay, for telling()

    def telling(self, rows: DataFrame) -> DataFrame:
        """Rows of each ``parent`` without the places at which all of them agree.

        Only places that every row of the parent has are left out, so places of two rows
        still correspond. Each row names the places at which it differs from one of them.
        A parent whose rows also agree in an earlier piece goes: all its pairs are found
        under that piece, so a pair is decided under its first common piece only.
        """
        of_parent = rows.groupBy("parent").agg(
            F.count(F.lit(1)).alias("rows"), F.min(F.length("rest")).alias("least"), F.min("rest").alias("model")
        )
        spread = join_groups(rows, pin(of_parent), ["parent"], "rows").withColumns(
            {"chars": F.split("rest", ""), "model": F.split("model", "")}
        )
        places = F.when(F.col("least") > 0, F.sequence(F.lit(0), F.col("least") - 1))
        differing = F.filter(places, lambda i: F.get("chars", i) != F.get("model", i))
        piece = ["parent", "rows", F.col("width").alias("piece_width"), F.col("place").alias("piece_place")]
        # The place -1 stands for a parent whose rows agree everywhere.
        each = F.explode(F.concat(F.array(F.lit(-1)), F.coalesce(differing, F.array())))
        telling = spread.select(*piece, each.alias("differs")).distinct()
        of_places = telling.groupBy("parent", "rows", "piece_width", "piece_place").agg(
            F.array_sort(F.collect_list(F.when(F.col("differs") >= 0, F.col("differs")))).alias("places")
        )
        before = F.filter("places", lambda i: i < F.col("piece_width") * F.col("piece_place"))
        earlier = F.array_distinct(F.transform(before, lambda i: F.floor(i / F.greatest("piece_width", F.lit(1)))))
        known = of_places.filter(F.size(earlier) == F.col("piece_place")).select("parent", "rows", "places")
        kept = F.array_join(F.transform("places", lambda i: F.get("chars", i)), "")
        rest = F.concat(kept, F.substr("rest", F.col("least") + 1))
        thinned = join_groups(spread.drop("rows"), pin(known), ["parent"], "rows")
        gone = ["rows", "least", "model", "chars", "places", "width", "place"]
        return thinned.withColumn("rest", rest).drop(*gone)

    def verified(self, pairs: DataFrame) -> DataFrame:
        score = positional_similarity(F.col("x_text"), F.col("y_text"))
        shorter = F.least(F.length("x_text"), F.length("y_text"))
        longer = F.greatest(F.length("x_text"), F.length("y_text"))
        return (
            pairs.filter(shorter >= longer * self.threshold - EPS)
            .withColumn("score", score)
            .filter(F.col("score") >= self.threshold)
            .select("x", "y", "score")
            .distinct()
        )


class Sequence:
    """difflib ratio 2M/(la+lb): at most D = (1-t)(la+lb) characters are unmatched.

    Each unmatched character spoils at most one piece of the shorter prompt, so of D+1 or
    more pieces one occurs in the longer prompt, moved by at most D places. The shorter
    prompt gives its pieces, the longer one all its substrings of the widths in question.
    A refined signature adds both lengths.
    """

    def __init__(self, threshold: float):
        if not 0.8 <= threshold <= 1.0:
            raise ValueError("sequence similarity is searched for thresholds from 0.8 to 1")
        self.threshold = threshold
        self.stretch = (2 - threshold) / threshold

    def _width(self, length: Column) -> Column:
        unmatched = _floor((length + _floor(length * self.stretch)) * (1 - self.threshold))
        return F.floor(length / (unmatched + 1)).cast("int")

    def start(self, nodes: DataFrame) -> DataFrame:
        size = F.length("text")
        texts = nodes.filter(size > 0).withColumn("bag", character_bag(F.col("text")))
        lengths = F.sequence(F.greatest(_ceil(size / self.stretch), F.lit(1)), size)

        def rows(widths: Column, step: Column, role: int) -> DataFrame:
            wide = texts.withColumn("width", F.explode(widths)).filter(F.col("width") > 0)
            each = wide.withColumn("pos", F.explode(F.sequence(F.lit(0), size - F.col("width"), step)))
            piece = F.substr("text", F.col("pos") + 1, F.col("width"))
            return each.select(
                "idx",
                "text",
                "bag",
                F.xxhash64("width", piece).alias("sig"),
                "pos",
                F.lit(role).alias("role"),
            )

        own = rows(F.array(self._width(size)), F.col("width"), FIRST_ROLE)
        others = F.array_distinct(F.transform(lengths, self._width))
        return own.unionByName(rows(others, F.lit(1), SECOND_ROLE))

    def telling(self, rows: DataFrame) -> DataFrame:
        """Places of two texts need not correspond here, so all of them stay."""
        return rows

    def refine(self, rows: DataFrame) -> DataFrame:
        size = F.length("text")
        first = F.col("role") == FIRST_ROLE
        longer = F.sequence(size, F.greatest(_floor(size * self.stretch), size))
        shorter = F.sequence(F.greatest(_ceil(size / self.stretch), F.lit(1)), size)
        other = rows.withColumn("other", F.explode(F.when(first, longer).otherwise(shorter)))
        low, high = F.least(size, F.col("other")), F.greatest(size, F.col("other"))
        return other.withColumn("sig", F.xxhash64("sig", low, high)).drop("other")

    def verified(self, pairs: DataFrame) -> DataFrame:
        total = F.length("x_text") + F.length("y_text")
        unmatched = _floor(total * (1 - self.threshold))
        near = F.abs(F.col("x_pos") - F.col("y_pos")) <= unmatched
        shorter = F.least(F.length("x_text"), F.length("y_text"))
        least = total * self.threshold - EPS
        reachable = (2 * shorter >= least) & (
            2 * common_characters(F.col("x_bag"), F.col("y_bag")) >= least
        )
        ratio = sequence_ratio_of(self.threshold)
        return (
            pairs.filter(near & reachable)
            .dropDuplicates(["x", "y"])
            .withColumn("score", ratio("x_text", "y_text"))
            .filter(F.col("score") >= self.threshold)
            .select("x", "y", "score")
        )


COLUMNS = ["idx", "text", "bag", "pos", "role"]


def _sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows per signature, and whether it is shared by two prompts."""
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.min("idx").alias("low"), F.max("idx").alias("high")
    )
    return groups.withColumn("shared", F.col("low") < F.col("high")).drop("low", "high")


def _signatures(nodes: DataFrame, measure, hot: int) -> DataFrame:
    """Signatures that at least two prompts share, ``size`` is how many rows one has.

    A signature of more than ``hot`` rows is replaced by refined ones if these give less
    than half of its candidates. They do for prompts that merely begin alike, but not for
    a cluster of near copies, which is left to the rounds.
    """
    rows = measure.start(nodes)
    shared = _sizes(rows, "sig").filter("shared").drop("shared")
    sized = pin(join_groups(rows, shared, ["sig"], "size"))
    kept = []
    for _ in range(MAX_DEPTH - 1):
        crowded = sized.filter(F.col("size") > hot)
        if crowded.isEmpty():
            break
        kept.append(sized.filter(F.col("size") <= hot))
        parents = crowded.withColumnsRenamed({"size": "whole"}).withColumn("parent", F.col("sig"))
        children = measure.refine(measure.telling(parents))
        sizes = pin(_sizes(children, "parent", "sig", "whole"))
        square = F.when(F.col("shared"), F.col("size").cast("double") * F.col("size"))
        costs = sizes.groupBy("parent", "whole").agg(
            F.coalesce(F.sum(square), F.lit(0.0)).alias("cost")
        )
        whole = F.col("whole").cast("double")
        pays = F.col("cost") * 2 < whole * whole
        staying = costs.filter(~pays).select(F.col("parent").alias("sig"), F.col("whole").alias("size"))
        kept.append(join_groups(crowded.drop("size"), staying, ["sig"], "size"))
        paying = costs.filter(pays).select("parent")
        chosen = sizes.filter("shared").join(paying, "parent", "left_semi").select("sig", "size")
        sized = pin(join_groups(children.drop("parent", "whole"), chosen, ["sig"], "size"))
    kept.append(sized)
    signatures = kept[0].select("sig", "size", *COLUMNS)
    for rows in kept[1:]:
        signatures = signatures.unionByName(rows.select("sig", "size", *COLUMNS))
    return pin(signatures)


# -- rounds ----------------------------------------------------------------------------


def _prefix_end(signatures: DataFrame, first: int, last: int, budget: int) -> int:
    """End of the longest prefix, among doubling lengths, whose candidates fit the budget."""
    ends, step = [], 16
    while first + step <= last:
        ends.append(first + step)
        step *= 2
    ends.append(last + 1)
    inside = [F.count_if(F.col("idx") < end).alias(f"n{i}") for i, end in enumerate(ends)]
    groups = signatures.groupBy("sig").agg(F.count(F.lit(1)).cast("double").alias("n"), *inside)
    costs = groups.agg(*[F.sum(F.col(f"n{i}") * F.col("n")) for i in range(len(ends))]).first()
    fitting = [end for end, cost in zip(ends, costs) if (cost or 0) <= budget]
    return fitting[-1] if fitting else ends[0]


def _similar_pairs(signatures: DataFrame, end: int, total: int, measure) -> DataFrame:
    """Verified pairs x < y with x in the prefix.

    Signatures with more than a thousandth of all rows are spread over several tasks.
    """
    spread = F.when(F.col("size") > total / 1000, F.lit(SPREAD)).otherwise(F.lit(1))
    left = signatures.filter(F.col("idx") < end).select(
        "sig",
        F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"),
        *[F.col(name).alias(f"x_{name}") for name in COLUMNS],
    )
    right = signatures.select(
        "sig",
        F.pmod(F.xxhash64("idx"), spread).cast("int").alias("salt"),
        *[F.col(name).alias(f"y_{name}") for name in COLUMNS],
    )
    both = F.col("x_role").bitwiseOR(F.col("y_role")) == (FIRST_ROLE | SECOND_ROLE)
    pairs = left.join(right, ["sig", "salt"]).filter((F.col("x_idx") < F.col("y_idx")) & both)
    named = pairs.withColumnsRenamed({"x_idx": "x", "y_idx": "y"})
    return measure.verified(named)


def _members_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members among pairs that come in the order of ``y``: some smaller ``x`` is none itself."""
    members: set[int] = set()
    for batch in batches:
        for x, y in zip(batch["x"].tolist(), batch["y"].tolist()):
            if x not in members:
                members.add(y)
    yield pd.DataFrame({"y": sorted(members)}, dtype="int64")


def _members(pairs: DataFrame, in_one_task: int) -> DataFrame:
    """Prompts ``y`` of the prefix that belong to some leader.

    A prompt whose smaller neighbours are all settled as members leads; its neighbours are
    members; pairs of members settle nothing and go. This is repeated while more than
    ``in_one_task`` pairs are open; so few are settled by one task in a single pass.
    """
    found = []
    open_pairs = pairs.select("x", "y")
    while open_pairs.count() > in_one_task:
        waiting = open_pairs.select("y").distinct()
        degrees = open_pairs.groupBy("x").agg(F.count(F.lit(1)).alias("count"))
        leading = degrees.join(waiting, degrees["x"] == waiting["y"], "left_anti")
        settled = pin(join_groups(open_pairs, leading, ["x"]).select("y").distinct())
        found.append(settled)
        staying = degrees.join(waiting, degrees["x"] == waiting["y"], "left_semi")
        staying = staying.join(settled, staying["x"] == settled["y"], "left_anti")
        rest = join_groups(open_pairs, staying, ["x"]).select("x", "y")
        open_pairs = pin(rest.join(settled, "y", "left_anti"))
    in_order = open_pairs.repartition(1).sortWithinPartitions("y", "x")
    members = in_order.mapInPandas(_members_in_order, "y long")
    for settled in found:
        members = members.unionByName(settled)
    return pin(members)


def _settle(
    signatures: DataFrame, last: int, measure, budget: int | None, in_one_task: int
) -> Iterator[DataFrame]:
    """Rounds of the greedy grouping; each gives ``y`` with its leader ``x`` and the score."""
    first = 0
    while True:
        total = signatures.count()
        if total == 0:
            return
        end = _prefix_end(signatures, first, last, budget or max(20 * total, 5_000_000))
        edges = pin(_similar_pairs(signatures, end, total, measure))
        members = _members(edges.filter(F.col("y") < end), in_one_task)
        degrees = edges.groupBy("x").agg(F.count(F.lit(1)).alias("count"))
        leading = degrees.join(members, degrees["x"] == members["y"], "left_anti")
        best = F.min(F.struct("x", "score"))
        settled = pin(
            join_groups(edges, leading, ["x"])
            .groupBy("y")
            .agg(best.alias("best"))
            .select("y", "best.x", "best.score")
        )
        yield settled
        if end > last:
            return
        first = end
        left = signatures.filter(F.col("idx") >= end)
        signatures = pin(left.join(settled.select(F.col("y").alias("idx")), "idx", "left_anti"))


def leader_pairs(
    texts: DataFrame,
    measure,
    hot: int = HOT,
    budget: int | None = None,
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Members and their leaders among distinct ``text`` rows ordered by ``name``.

    Returns ``leader, member, score``, the texts' names. ``hot`` is the number of rows above
    which a signature is refined, ``budget`` bounds the candidates of one round and
    ``in_one_task`` the pairs that one task may settle.
    """
    nodes = pin(with_dense_index(texts.select("text", "name"), [F.col("name")], "idx"))
    last = (nodes.agg(F.max("idx")).first()[0] or 0) if not nodes.isEmpty() else 0
    signatures = _signatures(nodes.select("idx", "text"), measure, hot)
    found = nodes.sparkSession.createDataFrame([], "y long, x long, score double")
    for settled in _settle(signatures, last, measure, budget, in_one_task):
        found = found.unionByName(settled)
    names = nodes.select("idx", "name")
    sized = names.join(
        found.groupBy(F.col("x").alias("idx")).agg(F.count(F.lit(1)).alias("count")), "idx"
    )
    leaders = sized.select(F.col("idx").alias("x"), F.col("name").alias("leader"), "count")
    named = join_groups(found, leaders, ["x"])
    pairs = named.join(names, named["y"] == names["idx"])
    return pin(pairs.select("leader", F.col("name").alias("member"), "score"))


# -- operators -------------------------------------------------------------------------


def similar_queries(
    results: DataFrame,
    threshold: float = 0.8,
    hot: int = HOT,
    budget: int | None = None,
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Prompts listed with the leader they resemble: ``query_text, similar_query, similarity``.

    Similarity counts equal characters at equal places and ignores case.
    """
    if not 0.0 <= threshold < 1.0:
        raise ValueError("threshold must be at least 0 and below 1")
    queries = results.select("query").distinct().withColumn("text", F.lower("query"))
    if threshold == 0.0:
        # Everything resembles the first prompt.
        first = queries.agg(F.min("query").alias("query_text"))
        rest = queries.join(F.broadcast(first), F.col("query") != F.col("query_text"))
        score = positional_similarity(F.lower("query_text"), F.col("text"))
        return rest.select(
            "query_text", F.col("query").alias("similar_query"), score.alias("similarity")
        )
    # Prompts that differ in case only have the same neighbours; the first one stands for all.
    folded = pin(
        queries.groupBy("text").agg(F.min("query").alias("name"), F.count(F.lit(1)).alias("count"))
    )
    pairs = leader_pairs(folded, Positional(threshold), hot, budget, in_one_task)
    found = folded.join(pairs, folded["name"] == pairs["member"], "left").select(
        "text",
        "count",
        F.coalesce("leader", "name").alias("query_text"),
        F.coalesce("score", F.lit(1.0)).alias("similarity"),
    )
    named = join_groups(queries, found, ["text"])
    return named.filter(F.col("query") != F.col("query_text")).select(
        "query_text", F.col("query").alias("similar_query"), "similarity"
    )


def fuzzy_groups(
    results: DataFrame,
    threshold: float = 0.8,
    hot: int = HOT,
    budget: int | None = None,
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Groups of similar prompts, one row per member: ``query_text, count, similar_query``.

    ``count`` includes the leader. A threshold of 1 means equal prompts: one row per prompt
    with several runs, their number, and no similar prompt.
    """
    if threshold == 1.0:
        return duplicate_queries(results).withColumn("similar_query", F.lit(None).cast("string"))
    pairs = pin(similar_queries(results, threshold, hot, budget, in_one_task))
    sizes = pairs.groupBy("query_text").agg(F.count(F.lit(1)).alias("members"))
    return join_groups(pairs, sizes, ["query_text"], "members").select(
        "query_text", (F.col("members") + 1).alias("count"), "similar_query"
    )


def sequence_similar(
    results: DataFrame,
    threshold: float = 0.9,
    hot: int = HOT,
    budget: int | None = None,
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Prompts with a difflib ratio of at least ``threshold`` to their leader, case counts."""
    queries = results.select("query").distinct()
    texts = queries.select(F.col("query").alias("text"), F.col("query").alias("name"))
    return leader_pairs(texts, Sequence(threshold), hot, budget, in_one_task).select(
        F.col("leader").alias("query_text"),
        F.col("member").alias("similar_query"),
        F.col("score").alias("similarity"),
    )
