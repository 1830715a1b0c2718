"""Runs and aggregates as text: Markdown blocks, tables and reports.

A report is a frame of text pieces with sort keys; Spark writes it in order, in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlog.functions.scalars import (
    PREVIEW_CHARS,
    answer_preview,
    domain_for_display,
    fixed_decimals,
    model_label,
    show_time,
    truncate_text,
)
from answerlog.operators import rollups
from answerlog.session import with_dense_index


def _lines(*pieces: Column | str) -> Column:
    """Join pieces by line ends; NULL pieces are left out."""
    return F.concat_ws(
        "\n", *[F.lit(piece) if isinstance(piece, str) else piece for piece in pieces]
    )


def _said(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def _seconds(digits: int) -> Column:
    time = F.coalesce("execution_time_seconds", F.lit(0.0))
    return F.concat(fixed_decimals(time, digits), F.lit("s"))


def _mark(success: Column) -> Column:
    return F.when(F.coalesce(success, F.lit(True)), "✓").otherwise("✗")


def _numbered_links(links: Column) -> Column:
    def item(link: Column, place: Column) -> Column:
        text = F.coalesce(link["text"], F.lit("Link"))
        shown = F.when(
            F.coalesce(link["url"], F.lit("")) != "",
            F.concat(F.lit("["), text, F.lit("]("), link["url"], F.lit(")")),
        ).otherwise(text)
        return F.concat((place + 1).cast("string"), F.lit(". "), shown)

    return F.array_join(F.transform(links, item), "\n")


def markdown_block(full: bool = True) -> Column:
    """One run as a Markdown block. Needs parsed ``sources``."""
    answer = F.coalesce("answer_text", F.lit(""))
    links = F.when(
        F.size("sources") > 0,
        _lines("**Sources**:\n", _numbered_links(F.col("sources")), ""),
    )
    return _lines(
        F.concat(F.lit('### Query: "'), F.col("query"), F.lit('"\n')),
        "",
        _said("- **Model**: ", model_label(F.col("model"), "unknown")),
        _said("- **Timestamp**: ", F.coalesce(show_time(F.col("timestamp")), F.lit("None"))),
        _said("- **Execution Time**: ", _seconds(1)),
        _said("- **Success**: ", _mark(F.col("success"))),
        "",
        "**Answer**:\n",
        answer if full else truncate_text(answer, PREVIEW_CHARS),
        "",
        links,
        "---\n",
    )


def report_block(full: bool = True) -> Column:
    """One run as a numbered section. Needs parsed ``sources`` and a ``number`` column."""
    answer = F.col("answer_text")
    shown = answer if full else answer_preview(answer)
    bullets = F.transform(
        F.col("sources"),
        lambda link: F.concat(
            F.lit("- ["),
            F.coalesce(link["text"], F.lit("Source")),
            F.lit("]("),
            F.coalesce(link["url"], F.lit("#")),
            F.lit(")"),
        ),
    )
    return F.concat_ws(
        "\n\n",
        _said("## Result ", F.col("number").cast("string")),
        _said("**Query:** ", F.col("query")),
        _said("**Model:** ", model_label(F.col("model"), "default")),
        _said("**Timestamp:** ", F.coalesce(show_time(F.col("timestamp")), F.lit("N/A"))),
        _said("**Status:** ", F.when(F.col("success"), "Success").otherwise("Failed")),
        _said("**Execution Time:** ", _seconds(2)),
        F.when(F.coalesce(answer, F.lit("")) != "", _said("### Answer\n\n", shown)),
        F.when(F.size("sources") > 0, _said("### Sources\n\n", F.array_join(bullets, "\n"))),
        F.lit("---\n"),
    )


def display_text(full: bool = True) -> Column:
    """One run as plain text for a terminal. Needs parsed ``sources``."""
    answer = F.coalesce("answer_text", F.lit(""))
    failed = ~F.coalesce("success", F.lit(True))

    def item(link: Column, place: Column) -> Column:
        domain = domain_for_display(link["domain"], link["url"])
        return F.concat(
            F.coalesce(link["citation_number"], place + 1).cast("string"),
            F.lit(". "),
            F.coalesce(link["text"], F.lit("N/A")),
            F.when(domain != "", F.concat(F.lit(" ["), domain, F.lit("]"))).otherwise(F.lit("")),
            F.lit("\n   "),
            F.coalesce(link["url"], F.lit("N/A")),
            F.lit("\n"),
        )

    links = F.when(
        F.size("sources") > 0,
        _lines(
            F.concat(F.lit("\nSources ("), F.size("sources").cast("string"), F.lit("):")),
            "-" * 80,
            F.array_join(F.transform("sources", item), "\n"),
        ),
    )
    return _lines(
        "=" * 80,
        _said("ID: ", F.col("id").cast("string")),
        _said("Query: ", F.col("query")),
        _said("Model: ", model_label(F.col("model"), "default")),
        _said("Timestamp: ", F.coalesce(show_time(F.col("timestamp")), F.lit("N/A"))),
        _said("Execution Time: ", _seconds(2)),
        _said("Success: ", _mark(F.col("success"))),
        F.when(failed, _said("Error: ", F.nullif("error_message", F.lit("")))),
        _said("Screenshot: ", F.nullif("screenshot_path", F.lit(""))),
        F.concat(F.lit("\nAnswer ("), F.length(answer).cast("string"), F.lit(" chars):")),
        "-" * 80,
        answer if full else answer_preview(answer),
        links,
    )


def markdown_table(rows: DataFrame, headers: dict[str, str], order: list[str]) -> DataFrame:
    """Lines of a Markdown table: ``place, line``, for an aggregate of few rows.

    ``headers`` maps columns to titles, ``order`` sorts the rows. No rows give no table.
    """
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in headers])
    body = with_dense_index(
        rows.withColumn("line", F.concat(F.lit("| "), cells, F.lit(" |"))),
        [F.col(name) for name in order],
        "place",
        2,
    ).select("place", "line")
    titles = "| " + " | ".join(headers.values()) + " |"
    rule = "| " + " | ".join(["---"] * len(headers)) + " |"
    head = (
        body.agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 0")
        .select(F.posexplode(F.array(F.lit(titles), F.lit(rule))).alias("place", "line"))
        .select(F.col("place").cast("long").alias("place"), "line")
    )
    return head.unionByName(body)


def _section(lines: DataFrame, number: int) -> DataFrame:
    return lines.select(F.lit(number).alias("section"), "place", "line")


def _heading(results: DataFrame, number: int, *lines: Column | str) -> DataFrame:
    """A section made of totals over ``results`` and fixed lines."""
    texts = F.array(*[F.lit(line) if isinstance(line, str) else line for line in lines])
    return results.select(F.posexplode(texts).alias("place", "line")).select(
        F.lit(number).alias("section"), F.col("place").cast("long").alias("place"), "line"
    )


def _time_shown(generated: str | None) -> Column:
    if generated is not None:
        return F.lit(generated)
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def _percent(value: Column, digits: int) -> Column:
    shown = F.bround(value).cast("long").cast("string") if digits == 0 else fixed_decimals(value, digits)
    return F.concat(shown, F.lit("%"))


def comparison_report(
    results: DataFrame, query: str, chars: int | None = None, generated: str | None = None
) -> DataFrame:
    """Models side by side for one prompt: ``section, place, line`` in reading order.

    Answers are whole unless cut at ``chars``; ``generated`` is the time to show, else now.
    """
    asked = results.filter(F.col("query") == F.lit(query))
    totals = asked.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(model_label(F.col("model"), "unknown")).alias("models"),
    ).filter("total > 0")
    head = _heading(
        totals,
        0,
        "# Model Comparison\n",
        f'Query: "{query}"\n',
        F.concat(F.lit("Generated: "), _time_shown(generated), F.lit("\n")),
        F.concat(F.lit("Models Compared: "), F.col("models").cast("string"), F.lit("\n\n")),
        F.concat(F.lit("Total Results: "), F.col("total").cast("string"), F.lit("\n\n")),
        "## Comparison Table\n",
    )
    table = rollups.comparison_table(results, query).select(
        "model",
        "count",
        F.concat(fixed_decimals(F.col("avg_time"), 1), F.lit("s")).alias("time"),
        _percent(F.col("success_percent"), 0).alias("rate"),
    )
    titles = {
        "model": "Model",
        "count": "Count",
        "time": "Avg Execution Time",
        "rate": "Success Rate",
    }
    details = asked.withColumn("label", model_label(F.col("model"), "unknown"))
    numbered = with_dense_index(
        details, [F.col("label"), F.desc("timestamp"), F.desc("id")], "place"
    )
    firsts = numbered.groupBy("label").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("runs")
    )
    number = F.col("place") - F.col("first") + 1
    title = F.when(
        F.col("place") == F.col("first"),
        F.concat(
            F.lit("### "), F.col("label"), F.lit("\nResults: "), F.col("runs").cast("string"), F.lit("\n")
        ),
    )
    block = _lines(
        title,
        F.concat(F.lit("#### Result "), number.cast("string"), F.lit("\n")),
        _said("- **Timestamp**: ", F.coalesce(show_time(F.col("timestamp")), F.lit("None"))),
        _said("- **Execution Time**: ", _seconds(1)),
        _said("- **Success**: ", _mark(F.col("success"))),
        "",
        F.coalesce("answer_text", F.lit("")) if chars is None else truncate_text(F.col("answer_text"), chars),
        "",
    )
    body = numbered.join(F.broadcast(firsts), "label").select("place", block.alias("line"))
    between = _heading(totals, 2, "\n## Detailed Results\n")
    return (
        head.unionByName(_section(markdown_table(table, titles, ["model"]), 1))
        .unionByName(between)
        .unionByName(_section(body, 3))
        .orderBy("section", "place")
    )


def summary_report(
    results: DataFrame, queries: int | None = None, generated: str | None = None
) -> DataFrame:
    """Totals, models and prompts, or the first of them: ``section, place, line``."""
    overall = rollups.summary_overall(results)
    unique = results.agg(
        F.countDistinct("query").alias("unique_queries"),
        F.countDistinct("model").alias("unique_models"),
    )
    totals = overall.withColumns(
        {name: unique.select(name).scalar() for name in ("unique_queries", "unique_models")}
    )

    def said(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- **{label}**: "), value)

    def whole(name: str) -> Column:
        return F.col(name).cast("string")

    def tenth(name: str, unit: str) -> Column:
        return F.concat(fixed_decimals(F.col(name), 1), F.lit(unit))

    head = _heading(
        totals,
        0,
        "# Database Summary\n",
        F.concat(F.lit("Generated: "), _time_shown(generated), F.lit("\n\n")),
        "## Overview\n",
        said("Total Results", whole("total_results")),
        said("Unique Queries", whole("unique_queries")),
        F.concat(said("Unique Models", whole("unique_models")), F.lit("\n")),
        "## Performance Statistics\n",
        said("Total Execution Time", tenth("total_time", "s")),
        said("Average Execution Time", tenth("avg_time", "s")),
        said("Success Rate", tenth("success_percent", "%")),
        F.concat(
            said("Successful Results", whole("successful")),
            F.lit("/"),
            whole("total_results"),
            F.lit("\n"),
        ),
        "## Content Statistics\n",
        said("Total Sources", whole("total_sources")),
        said("Average Sources per Result", tenth("avg_sources", "")),
        said("Total Answer Characters", whole("total_chars")),
        F.concat(
            said("Average Answer Length", F.bround("avg_chars").cast("long").cast("string")),
            F.lit(" characters\n"),
        ),
        "## Model Summary\n",
    )
    models = rollups.summary_by_model(results).select(
        "model",
        "count",
        _percent(F.col("success_percent"), 0).alias("rate"),
        tenth("avg_time", "s").alias("time"),
    )
    titles = {"model": "Model", "count": "Count", "rate": "Success Rate", "time": "Avg Time"}
    prompts = rollups.summary_query_counts(results, queries)
    between = _heading(totals, 2, "\n## Top Queries\n")
    return (
        head.unionByName(_section(markdown_table(models, titles, ["model"]), 1))
        .unionByName(between)
        .unionByName(
            _section(markdown_table(prompts, {"query": "Query", "count": "Count"}, ["query"]), 3)
        )
        .orderBy("section", "place")
    )
