"""Connected components of a graph given by edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlog.session import pin


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``comp`` (smallest vertex reachable) of every vertex of ``edges`` (``x``, ``y``).

    Rounds of taking the smallest label among neighbours and then the label's own label;
    the number of rounds grows with the logarithm of the longest path. Each round is
    pinned. Smallest labels are combined before the shuffle, so a star's centre is no hot
    spot there; joins are left to adaptive skew handling.
    """
    both = pin(
        edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        .filter("x <> y").distinct()
    )
    labels = pin(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select(
        "v", F.least("v", "m").alias("comp")
    ))
    while True:
        near = both.join(labels.select(F.col("v").alias("y"), "comp"), "y").groupBy(F.col("x").alias("v")).agg(
            F.min("comp").alias("near")
        )
        hooked = labels.join(near, "v").select("v", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("comp").alias("far"))
        moved = pin(
            hooked.join(jump, "next", "left").select(
                "v", F.least("next", F.coalesce("far", "next")).alias("comp"),
                (F.least("next", F.coalesce("far", "next")) < F.col("comp")).alias("changed"),
            )
        )
        if not moved.filter("changed").limit(1).count():
            return moved.select("v", "comp")
        labels = moved.select("v", "comp")
