"""Canonical model names for free-text labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical model names and their accepted spellings.
MODEL_ALIASES = {
    "sonar": ["Sonar", "sonar"],
    "gpt-5": ["GPT-5", "GPT 5", "gpt-5", "GPT5"],
    "gpt-5.1": ["GPT-5.1", "GPT 5.1", "gpt-5.1"],
    "claude-sonnet-4.5": ["Claude Sonnet 4.5", "Claude-Sonnet-4.5", "Sonnet 4.5"],
    "gemini-2.5-pro": ["Gemini 2.5 Pro", "Gemini-2.5-Pro", "Gemini 2.5"],
    "grok-4": ["Grok 4", "Grok-4", "Grok4"],
}


def resolve_model(label: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Canonical model of a label, NULL if none fits.

    Label and spelling match when one contains the other, in any case. An exact match
    wins, then the longest spelling, then the order of the map. The few spellings are
    literals of the expression, so labels are resolved in place without a join.
    """
    folded = F.lower(F.trim(label))
    spellings = [
        F.struct(
            F.lit(canonical).alias("canonical"),
            F.lit(spelling.lower()).alias("spelling"),
            F.lit(order).alias("order"),
        )
        for order, (canonical, spelling) in enumerate(
            (canonical, spelling)
            for canonical, names in (aliases or MODEL_ALIASES).items()
            for spelling in names
        )
    ]
    fitting = F.filter(
        F.array(*spellings),
        lambda alias: F.contains(folded, alias["spelling"]) | F.contains(alias["spelling"], folded),
    )
    ranked = F.transform(
        fitting,
        lambda alias: F.struct(
            (alias["spelling"] != folded).alias("inexact"),
            (-F.length(alias["spelling"])).alias("shortness"),
            alias["order"].alias("order"),
            alias["canonical"].alias("canonical"),
        ),
    )
    return F.when(folded != "", F.array_min(ranked)["canonical"])
