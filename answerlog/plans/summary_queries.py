"""Registered statistics, trends and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlog.functions.scalars import show_time
from answerlog.operators import distribution, mentions, rollups, timeseries
from answerlog.plans.base import ROW_COLUMNS, query, shown
from answerlog.plans.lookup_queries import END, PROMPT, START, runs
from answerlog.sources import testdata

TIME = "execution_time_seconds"
GOOD = "CAST(count(*) FILTER (WHERE success) AS BIGINT)"


def full(spark, sf_dir):
    return testdata.results(spark, sf_dir)


def six_sql(value: str, total: str, where: str = "true") -> str:
    return f"""SELECT round(avg(v), 6) AS mean, round(median(v), 6) AS median,
        round(stddev_samp(v), 6) AS std_dev, min(v) AS min, max(v) AS max, count(v) AS {total}
        FROM (SELECT CAST({value} AS DOUBLE) AS v FROM counted WHERE {where})"""


@query("execution_time_stats", "counted", six_sql(TIME, "total_queries"))
def execution_time_stats(spark, sf_dir):
    return rollups.execution_time_stats(runs(spark, sf_dir))


@query(
    "execution_time_stats_filtered",
    "counted",
    six_sql(
        TIME,
        "total_queries",
        f"model = 'model-1' AND \"timestamp\" >= TIMESTAMP '{START}' AND \"timestamp\" <= "
        f"TIMESTAMP '{END}'",
    ),
)
def execution_time_stats_filtered(spark, sf_dir):
    return rollups.execution_time_stats(runs(spark, sf_dir), "model-1", START, END)


@query(
    "success_rate_stats",
    "results",
    f"""SELECT count(*) AS total, {GOOD} AS successful, count(*) - {GOOD} AS failed,
        round({GOOD} / count(*), 6) AS success_rate,
        round((count(*) - {GOOD}) / count(*), 6) AS failure_rate FROM results""",
)
def success_rate_stats(spark, sf_dir):
    return rollups.success_rate_stats(runs(spark, sf_dir))


@query(
    "model_comparison_stats",
    "results",
    f"""SELECT model, round(coalesce(avg({TIME}), 0), 6) AS execution_time_mean,
        round({GOOD} / count(*), 6) AS success_rate,
        round(coalesce(avg(length(answer_text)) FILTER (WHERE answer_text <> ''), 0), 6)
          AS answer_length_mean, count(*) AS count
        FROM results WHERE model IS NOT NULL GROUP BY model""",
)
def model_comparison_stats(spark, sf_dir):
    return rollups.model_comparison(full(spark, sf_dir))


@query("answer_length_stats", "counted", six_sql("length(answer_text)", "total_answers"))
def answer_length_stats(spark, sf_dir):
    return rollups.answer_length_stats(full(spark, sf_dir))


@query(
    "source_count_stats",
    "counted",
    six_sql("source_count", "total_results", "sources IS NOT NULL"),
)
def source_count_stats(spark, sf_dir):
    return rollups.source_count_stats(runs(spark, sf_dir))


FORMATS = {
    "hour": "%Y-%m-%d %H:00:00",
    "day": "%Y-%m-%d 00:00:00",
    "week": "%Y-W%W",
    "month": "%Y-%m-01",
}
SHORT_FORMATS = {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "week": "%Y-W%W", "month": "%Y-%m"}


def _volume(period: str) -> None:
    key = f"strftime(\"timestamp\", '{FORMATS[period]}')"

    @query(
        f"query_volume_{period}",
        "results",
        f"SELECT {key} AS period, count(*) AS count FROM results GROUP BY 1 "
        "ORDER BY period DESC",
    )
    def volume(spark, sf_dir):
        return timeseries.query_volume(runs(spark, sf_dir), period)


METRIC_SQL = {
    "execution_time": TIME,
    "success_rate": "CAST(success AS DOUBLE)",
    "answer_length": "CAST(length(answer_text) AS DOUBLE)",
}


def _log_for(metric: str, spark, sf_dir):
    return full(spark, sf_dir) if metric == "answer_length" else runs(spark, sf_dir)


def _trend(metric: str, period: str) -> None:
    key = f"strftime(\"timestamp\", '{FORMATS[period]}')"
    value = METRIC_SQL[metric]

    @query(
        f"trend_{metric}_{period}",
        "results",
        f"SELECT {key} AS period, round(avg({value}), 6) AS value FROM results WHERE {value} IS "
        "NOT NULL GROUP BY 1 ORDER BY period DESC",
    )
    def trend(spark, sf_dir):
        return timeseries.trend(_log_for(metric, spark, sf_dir), metric, period)


def _trend_cli(metric: str, period: str) -> None:
    key = f"strftime(\"timestamp\", '{SHORT_FORMATS[period]}')"
    value = {
        "execution_time": f"avg({TIME})",
        "success_rate": f"{GOOD} * 100.0 / count(*)",
        "answer_length": "avg(length(answer_text))",
        "query_volume": "CAST(count(*) AS DOUBLE)",
    }[metric]
    count = "count(DISTINCT query)" if metric == "query_volume" else "count(*)"

    @query(
        f"trend_cli_{metric}_{period}",
        "results",
        f"SELECT {key} AS period, round({value}, 6) AS value, {count} AS count FROM results "
        "GROUP BY 1",
    )
    def trend(spark, sf_dir):
        return timeseries.trend_report(_log_for(metric, spark, sf_dir), metric, period)


for _period in FORMATS:
    _volume(_period)
for _metric in METRIC_SQL:
    for _period in FORMATS:
        _trend(_metric, _period)
for _metric in (*METRIC_SQL, "query_volume"):
    for _period in FORMATS:
        _trend_cli(_metric, _period)


# -- distribution ----------------------------------------------------------------------


def _distribution(metric: str) -> None:
    value = METRIC_SQL[metric]
    known = f"(SELECT {value} AS v FROM results WHERE {value} IS NOT NULL)"
    parts = " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS percentile, round(quantile_cont(v, {p / 100}), 6) AS value "
        f"FROM {known}"
        for p in distribution.DEFAULT_PERCENTILES
    )

    @query(f"percentiles_{metric}", "results", parts)
    def percentiles(spark, sf_dir):
        return distribution.percentiles(_log_for(metric, spark, sf_dir), metric)

    bounds = f"(SELECT min(v) AS low, max(v) AS high, (max(v) - min(v)) / 10.0 AS width FROM {known})"

    @query(
        f"histogram_{metric}",
        "results",
        f"""SELECT CAST(bin AS INT) AS bin, round(low + bin * width, 6) AS bin_start,
            round(low + bin * width + width, 6) AS bin_end,
            (SELECT count(*) FROM {known} WHERE (v >= low + bin * width AND (bin = 9 OR
              v < low + (bin + 1) * width))) AS count
            FROM {bounds}, range(0, 10) g(bin)""",
    )
    def histogram(spark, sf_dir):
        return distribution.histogram(_log_for(metric, spark, sf_dir), metric)

    # One failure in seven lies 2.4 deviations from the mean, so 2.5 would find none.
    deviations = 2.0 if metric == "success_rate" else 2.5

    @query(
        f"outliers_{metric}",
        "counted",
        f"""SELECT {ROW_COLUMNS} FROM counted WHERE abs({value} - (SELECT avg({value}) FROM counted))
            > {deviations} * (SELECT stddev_samp({value}) FROM counted)""",
    )
    def outliers(spark, sf_dir):
        return shown(distribution.outliers(full(spark, sf_dir), metric, deviations))


for _metric in METRIC_SQL:
    _distribution(_metric)


# -- summaries -------------------------------------------------------------------------

SUMMARY_SQL = f"""count(*) AS total_records, count(DISTINCT query) AS unique_queries,
  count(DISTINCT model) AS unique_models,
  strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') AS date_range_start,
  strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS date_range_end,
  round(avg({TIME}), 6) AS avg_execution_time,
  round(avg(length(answer_text)), 6) AS avg_answer_length"""


def _dated(summary):
    for name in ("date_range_start", "date_range_end"):
        summary = summary.withColumn(name, show_time(F.col(name)))
    return summary


@query(
    "database_summary",
    "counted",
    f"""SELECT {SUMMARY_SQL}, {GOOD} AS total_successful, count(*) - {GOOD} AS total_failed,
        round({GOOD} / count(*), 6) AS success_rate,
        CAST(sum(source_count) AS BIGINT) AS total_sources FROM counted""",
)
def database_summary(spark, sf_dir):
    return _dated(rollups.database_summary(full(spark, sf_dir)))


@query(
    "database_stats_cli",
    "counted",
    f"""SELECT {SUMMARY_SQL}, {GOOD} AS successful_records,
        round({GOOD} / count(*) * 100, 6) AS success_rate FROM counted""",
)
def database_stats_cli(spark, sf_dir):
    return _dated(rollups.database_stats(full(spark, sf_dir)))


MODEL_SQL = f"""model, count(*) AS record_count, {GOOD} AS successful,
  round(avg({TIME}), 6) AS avg_exec_time, min({TIME}) AS min_exec_time,
  max({TIME}) AS max_exec_time, round(avg(length(answer_text)), 6) AS avg_answer_length"""


@query(
    "model_stats_all",
    "results",
    f"""SELECT {MODEL_SQL}, count(DISTINCT query) AS unique_queries FROM results
        WHERE "timestamp" >= TIMESTAMP '{START}' GROUP BY model""",
)
def model_stats_all(spark, sf_dir):
    return rollups.model_stats_all(full(spark, sf_dir), START)


@query(
    "model_stats_one",
    "counted",
    f"""SELECT {MODEL_SQL}, round(avg(array_length), 6) AS avg_sources FROM counted
        WHERE model = 'model-3' GROUP BY model""",
)
def model_stats_one(spark, sf_dir):
    return rollups.model_stats_one(full(spark, sf_dir), "model-3")


@query(
    "performance_comparison",
    "results",
    f"""SELECT coalesce(nullif(model, ''), 'default') AS model, count(*) AS count,
        round({GOOD} * 100.0 / count(*), 6) AS success_percent,
        round(sum(coalesce({TIME}, 0)) / count(*), 6) AS avg_time,
        round(sum(coalesce(length(answer_text), 0)) / count(*), 6) AS avg_length
        FROM results GROUP BY 1""",
)
def performance_comparison(spark, sf_dir):
    return rollups.performance_comparison(full(spark, sf_dir))


def _summary_rows_sql(model: str, where: str) -> str:
    return f"""SELECT {model} AS model, count(*) AS count,
        round(sum(coalesce({TIME}, 0)) / count(*), 6) AS avg_time,
        round({GOOD} * 100.0 / count(*), 6) AS success_percent
        FROM results WHERE {where} GROUP BY 1"""


@query(
    "comparison_table",
    "results",
    _summary_rows_sql("coalesce(nullif(model, ''), 'unknown')", f"query = '{PROMPT}'"),
)
def comparison_table(spark, sf_dir):
    return rollups.comparison_table(runs(spark, sf_dir), PROMPT)


@query("summary_by_model", "results", _summary_rows_sql("model", "model IS NOT NULL"))
def summary_by_model(spark, sf_dir):
    return rollups.summary_by_model(runs(spark, sf_dir))


@query(
    "summary_overall",
    "counted",
    f"""SELECT count(*) AS total_results, round(sum({TIME}), 6) AS total_time,
        round(sum({TIME}) / count(*), 6) AS avg_time, {GOOD} AS successful,
        round({GOOD} * 100.0 / count(*), 6) AS success_percent,
        CAST(sum(source_count) AS BIGINT) AS total_sources,
        round(sum(source_count) / count(*), 6) AS avg_sources,
        CAST(sum(length(answer_text)) AS BIGINT) AS total_chars,
        round(sum(length(answer_text)) / count(*), 6) AS avg_chars FROM counted""",
)
def summary_overall(spark, sf_dir):
    return rollups.summary_overall(full(spark, sf_dir))


@query(
    "summary_query_counts",
    "results",
    "SELECT query, count(*) AS count FROM results GROUP BY query ORDER BY query",
)
def summary_query_counts(spark, sf_dir):
    return rollups.summary_query_counts(runs(spark, sf_dir))


@query(
    "top_queries",
    "results",
    "SELECT query, count(*) AS count FROM results GROUP BY query ORDER BY count DESC, query",
)
def top_queries(spark, sf_dir):
    return rollups.top_queries(runs(spark, sf_dir))


@query(
    "per_group_lookup",
    "results",
    f"""SELECT query, model, count(*) AS count, {GOOD} AS successful,
        strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS newest
        FROM results GROUP BY query, model""",
)
def per_group_lookup(spark, sf_dir):
    """Every prompt and model in one pass, in place of one lookup per group."""
    return (
        runs(spark, sf_dir)
        .groupBy("query", "model")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if("success").alias("successful"),
            show_time(F.max("timestamp")).alias("newest"),
        )
    )


@query(
    "first_appearance",
    "observations",
    """SELECT selector, elapsed, cnt, elapsed = min(elapsed) OVER () AS recommended FROM (
         SELECT *, row_number() OVER (PARTITION BY selector ORDER BY elapsed, entity) AS place
         FROM observations WHERE found) WHERE place = 1""",
)
def first_appearance(spark, sf_dir):
    return rollups.first_appearance(testdata.observations(spark, sf_dir))


# -- mentions, citations and changes ---------------------------------------------------

LABEL = "coalesce(nullif(model, ''), 'unknown')"
MONTH = "strftime(\"timestamp\", '%Y-%m-01')"
WEEK = "strftime(\"timestamp\", '%Y-W%W')"
TERMS = ["the", "There", "thing", "ing", "in the", "and", "que", "für"]
TERM_ROWS = ", ".join(f"('{term.lower()}')" for term in TERMS)


@query(
    "mention_share",
    "results",
    f""", terms(term) AS (VALUES {TERM_ROWS}),
      answers AS (SELECT {LABEL} AS model, {WEEK} AS period, lower(answer_text) AS text FROM results
        WHERE answer_text <> ''),
      groups AS (SELECT model, period, count(*) AS answers FROM answers GROUP BY ALL),
      found AS (SELECT model, period, term, count(*) AS mentioning, CAST(sum((length(text)
        - length(replace(text, term, ''))) // length(term)) AS BIGINT) AS mentions
        FROM answers JOIN terms ON contains(text, term) GROUP BY ALL)
      SELECT model, period, term, answers, mentioning, mentions, round(mentioning / answers, 6) AS share
      FROM found JOIN groups USING (model, period)""",
)
def mention_share(spark, sf_dir):
    terms = spark.createDataFrame([(term,) for term in TERMS], "term string")
    return mentions.mention_share(full(spark, sf_dir), terms, "week")


@query(
    "domain_citation_share",
    "results citations",
    f""", cited AS (SELECT {LABEL} AS model, regexp_replace(regexp_extract(c.url,
        '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\\.', '') AS domain
        FROM citations c JOIN results r ON r.id = c.result_id),
      counted AS (SELECT model, domain, count(*) AS citations FROM cited GROUP BY ALL)
      SELECT *, round(citations / sum(citations) OVER (PARTITION BY model), 6) AS share FROM counted""",
)
def domain_citation_share(spark, sf_dir):
    models = testdata.results(spark, sf_dir, answers=False).select("id", "model")
    cited = testdata.citations(spark, sf_dir)
    return mentions.domain_citation_share(cited.join(models, cited["result_id"] == models["id"]))


@query(
    "answer_change",
    "results",
    f""", answers AS (SELECT query, {LABEL} AS model, {MONTH} AS period, md5(answer_text) AS digest,
        lag(md5(answer_text)) OVER (PARTITION BY query, {LABEL} ORDER BY "timestamp", id) AS before
        FROM results WHERE answer_text <> '')
      SELECT query, model, period, count(*) AS compared, count(*) FILTER (WHERE digest <> before) AS changed,
        round(count(*) FILTER (WHERE digest <> before) / count(*), 6) AS rate
      FROM answers WHERE before IS NOT NULL GROUP BY ALL""",
)
def answer_change(spark, sf_dir):
    return mentions.answer_change(full(spark, sf_dir))
