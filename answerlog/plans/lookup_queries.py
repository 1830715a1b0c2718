"""Registered lookups, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlog.functions import predicates as P
from answerlog.functions import scalars as S
from answerlog.operators import dedup, distribution, lookups
from answerlog.operators.similarity import sequence_ratio_of
from answerlog.plans.base import ROW_COLUMNS, query, shown
from answerlog.sources import testdata
from answerlog.sources.results import with_parsed_sources

PROMPT = "view topic 29"
START, END = "2024-01-08", "2024-01-15"


def rows_sql(where: str, tail: str = "") -> str:
    return f"SELECT {ROW_COLUMNS} FROM counted WHERE {where} {tail}"


NEWEST = 'ORDER BY "timestamp" DESC, id DESC'


def whole(spark, sf_dir):
    """The whole log, for operators that return runs."""
    return testdata.results(spark, sf_dir)


def runs(spark, sf_dir):
    """The log without its answers, for what counts or reads other columns only."""
    return testdata.results(spark, sf_dir, answers=False)


@query("results_by_query", "counted", rows_sql(f"query = '{PROMPT}' AND model = 'model-1'"))
def results_by_query(spark, sf_dir):
    return shown(lookups.by_query(whole(spark, sf_dir), PROMPT, "model-1"))


@query("results_by_model", "counted", rows_sql("model = 'model-2'"))
def results_by_model(spark, sf_dir):
    return shown(lookups.by_model(whole(spark, sf_dir), "model-2"))


@query("recent_results", "counted", rows_sql("true", f"{NEWEST} LIMIT 50"))
def recent_results(spark, sf_dir):
    return shown(lookups.recent(whole(spark, sf_dir), 50))


@query(
    "results_by_date_range",
    "counted",
    rows_sql(
        f"\"timestamp\" >= TIMESTAMP '{START}' AND \"timestamp\" <= TIMESTAMP '{END}' "
        "AND model = 'model-0'"
    ),
)
def results_by_date_range(spark, sf_dir):
    return shown(lookups.by_date_range(whole(spark, sf_dir), START, END, "model-0"))


@query("results_by_success", "counted", rows_sql("NOT success"))
def results_by_success(spark, sf_dir):
    return shown(lookups.by_success(whole(spark, sf_dir), success=False))


@query(
    "results_by_execution_time",
    "counted",
    rows_sql("execution_time_seconds >= 20 AND execution_time_seconds <= 60.5"),
)
def results_by_execution_time(spark, sf_dir):
    return shown(lookups.by_execution_time(whole(spark, sf_dir), 20, 60.5))


@query("search_answers_ci", "counted", rows_sql("contains(lower(answer_text), lower('THE '))"))
def search_answers_ci(spark, sf_dir):
    return shown(lookups.search(testdata.results(spark, sf_dir), "THE "))


@query("search_answers_cs", "counted", rows_sql("contains(answer_text, 'The ')"))
def search_answers_cs(spark, sf_dir):
    found = lookups.search(testdata.results(spark, sf_dir), "The ", case_sensitive=True)
    return shown(found)


@query("search_sources_cs", "counted", rows_sql("contains(sources, 'ex.org/a')"))
def search_sources_cs(spark, sf_dir):
    return shown(lookups.search(whole(spark, sf_dir), "ex.org/a", "sources", case_sensitive=True))


@query("search_sources_ci", "counted", rows_sql("contains(lower(sources), 'json')"))
def search_sources_ci(spark, sf_dir):
    return shown(lookups.search(whole(spark, sf_dir), "JSON", "sources"))


@query("query_like", "counted", rows_sql("query ILIKE 'VIEW topic 1_'"))
def query_like(spark, sf_dir):
    return shown(lookups.query_like(whole(spark, sf_dir), "VIEW topic 1_"))


@query(
    "advanced_filter",
    "counted",
    rows_sql(
        "query ILIKE '%topic 4%' AND model = 'model-3' AND \"timestamp\" >= TIMESTAMP "
        f"'{START}' AND success AND execution_time_seconds >= 5 AND execution_time_seconds "
        "<= 200 AND length(answer_text) >= 100 AND length(answer_text) <= 8000 "
        "AND sources IS NOT NULL AND sources <> '[]'",
        "ORDER BY execution_time_seconds DESC, id DESC LIMIT 100",
    ),
)
def advanced_filter(spark, sf_dir):
    found = lookups.advanced_filter(
        testdata.results(spark, sf_dir),
        query_pattern="%topic 4%",
        model="model-3",
        start=START,
        success=True,
        min_time=5,
        max_time=200,
        min_length=100,
        max_length=8000,
        sources=True,
        order_by="execution_time_seconds",
        limit=100,
    )
    return shown(found)


@query(
    "advanced_filter_cli",
    "counted",
    rows_sql(
        f"query ILIKE '%TOPIC 2%' AND \"timestamp\" >= TIMESTAMP '{START}' AND \"timestamp\" "
        f"<= TIMESTAMP '{END} 23:59:59' AND NOT success AND sources IS NOT NULL AND sources <> ''"
    ),
)
def advanced_filter_cli(spark, sf_dir):
    found = lookups.advanced_filter(
        whole(spark, sf_dir),
        query_pattern="TOPIC 2",
        start=START,
        end=END,
        success=False,
        sources=True,
        order_by="query",
        descending=False,
        profile="report",
    )
    return shown(found)


@query(
    "search_all_columns",
    "counted",
    rows_sql(
        "model = 'model-4' AND (contains(lower(coalesce(answer_text, '')), 'b') OR "
        "contains(lower(query), 'b') OR contains(lower(coalesce(sources, '')), 'b'))"
    ),
)
def search_all_columns(spark, sf_dir):
    found = lookups.search(testdata.results(spark, sf_dir), "B", "all", model="model-4")
    return shown(found)


@query(
    "export_filters",
    "counted",
    f"SELECT {ROW_COLUMNS}, 4 AS filters_applied FROM counted WHERE contains(lower(query), "
    "'topic 7') AND success AND coalesce(execution_time_seconds, 0) <= 100 "
    f"AND CAST(\"timestamp\" AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'",
)
def export_filters(spark, sf_dir):
    rows, applied = lookups.export_filter(
        whole(spark, sf_dir),
        {
            "query_pattern": "Topic 7",
            "success": True,
            "max_exec_time": 100,
            "start_date": START,
            "end_date": END,
        },
    )
    return shown(rows).withColumn("filters_applied", F.lit(applied))


@query(
    "date_window_inclusive",
    "counted",
    rows_sql(
        "\"timestamp\" IS NULL OR CAST(\"timestamp\" AS DATE) BETWEEN "
        f"DATE '{START}' AND DATE '{END}'"
    ),
)
def date_window_inclusive(spark, sf_dir):
    window = P.time_window(F.col("timestamp"), START, END, "date")
    return shown(whole(spark, sf_dir).filter(window))


@query(
    "export_precedence",
    "counted",
    f"SELECT 'query' AS chosen_by, {ROW_COLUMNS} FROM counted WHERE query = '{PROMPT}' "
    f"UNION ALL (SELECT 'model', {ROW_COLUMNS} FROM counted WHERE model = 'model-1') UNION ALL (SELECT 'recent', {ROW_COLUMNS} FROM counted {NEWEST} LIMIT 7)",
)
def export_precedence(spark, sf_dir):
    log = whole(spark, sf_dir)
    chosen = {
        "query": lookups.export_selection(log, query=PROMPT, limit=2),
        "model": lookups.export_selection(log, model="model-1"),
        "recent": lookups.export_selection(log, limit=7),
    }
    parts = [
        shown(rows).select(F.lit(name).alias("chosen_by"), "*") for name, rows in chosen.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "has_citations",
    "counted",
    "SELECT id, source_count > 0 AS parsed, sources IS NOT NULL AND sources <> '[]' AS "
    "not_empty_list, sources IS NOT NULL AND sources <> '' AS not_blank FROM counted",
)
def has_citations(spark, sf_dir):
    modes = ("parsed", "not_empty_list", "not_blank")
    return runs(spark, sf_dir).select(
        "id", *[P.has_sources(F.col("sources"), mode).alias(mode) for mode in modes]
    )


# -- scalar functions ------------------------------------------------------------------


@query("answer_length", "results", "SELECT id, length(answer_text) AS answer_length FROM results")
def answer_length(spark, sf_dir):
    log = testdata.results(spark, sf_dir)
    return log.select("id", S.answer_length(F.col("answer_text")).alias("answer_length"))


@query("source_count", "counted", "SELECT id, source_count FROM counted")
def source_count(spark, sf_dir):
    return runs(spark, sf_dir).select("id", S.source_count(F.col("sources")).alias("source_count"))


@query("json_array_length", "counted", "SELECT id, array_length FROM counted")
def json_array_length(spark, sf_dir):
    length = S.json_array_length(F.col("sources"))
    return runs(spark, sf_dir).select("id", length.alias("array_length"))


def _periods(spark, sf_dir, style):
    keys = [
        S.period_key(F.col("timestamp"), period, style).alias(f"{period}_key")
        for period in S.PERIODS
        if style != "iso" or period != "hour"
    ]
    return runs(spark, sf_dir).select("id", *keys)


def _periods_sql(formats: dict[str, str]) -> str:
    keys = [f"strftime(\"timestamp\", '{text}') AS {name}_key" for name, text in formats.items()]
    return f"SELECT id, {', '.join(keys)} FROM results"


@query(
    "period_key",
    "results",
    _periods_sql(
        {
            "hour": "%Y-%m-%d %H:00:00",
            "day": "%Y-%m-%d 00:00:00",
            "week": "%Y-W%W",
            "month": "%Y-%m-01",
        }
    ),
)
def period_key(spark, sf_dir):
    return _periods(spark, sf_dir, "start")


@query(
    "period_key_cli",
    "results",
    _periods_sql({"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "week": "%Y-W%W", "month": "%Y-%m"}),
)
def period_key_cli(spark, sf_dir):
    return _periods(spark, sf_dir, "short")


@query(
    "period_key_iso",
    "results",
    _periods_sql({"day": "%Y-%m-%d", "week": "%Y-W%V", "month": "%Y-%m"}),
)
def period_key_iso(spark, sf_dir):
    return _periods(spark, sf_dir, "iso")


AUTHORITY = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


@query(
    "domain_of_url",
    "",
    f"SELECT page_id, regexp_replace({AUTHORITY}, '^www\\.', '') AS domain FROM pages",
)
def domain_of_url(spark, sf_dir):
    pages = testdata.table(spark, sf_dir, "pages")
    return pages.select("page_id", S.domain_of_url(F.col("url")).alias("domain"))


@query(
    "domain_for_display",
    "",
    "SELECT page_id, coalesce(nullif(CASE page_id % 3 WHEN 0 THEN 'kept.example' WHEN 1 THEN '' "
    f"END, ''), {AUTHORITY}) AS domain FROM pages",
)
def domain_for_display(spark, sf_dir):
    number = F.col("page_id")
    stored = F.when(number % 3 == 0, "kept.example").when(number % 3 == 1, "")
    pages = testdata.table(spark, sf_dir, "pages")
    return pages.select("page_id", S.domain_for_display(stored, F.col("url")).alias("domain"))


TEST_PARTS = ["casino", "free-bets", "ADS-track"]


@query(
    "is_excluded_url",
    "",
    "SELECT page_id, "
    + " OR ".join(
        f"contains(lower(url), '{part.lower()}')" for part in S.EXCLUDED_URL_PARTS + TEST_PARTS
    )
    + " AS excluded FROM pages",
)
def is_excluded_url(spark, sf_dir):
    excluded = S.is_excluded_url(F.col("url"), S.EXCLUDED_URL_PARTS + TEST_PARTS)
    return testdata.table(spark, sf_dir, "pages").select("page_id", excluded.alias("excluded"))


@query(
    "truncate_text",
    "",
    "SELECT doc_id, CASE WHEN length(text) > 500 THEN rtrim(substring(text, 1, 500), "
    f"'{S.WHITE_SPACE}') || '...' ELSE text END AS shown FROM documents",
)
def truncate_text(spark, sf_dir):
    documents = testdata.table(spark, sf_dir, "documents")
    return documents.select("doc_id", S.truncate_text(F.col("text")).alias("shown"))


@query(
    "answer_preview",
    "",
    "SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' "
    "ELSE text END AS shown FROM documents",
)
def answer_preview(spark, sf_dir):
    documents = testdata.table(spark, sf_dir, "documents")
    return documents.select("doc_id", S.answer_preview(F.col("text"), 300).alias("shown"))


@query(
    "format_timestamp",
    "",
    """WITH written AS (SELECT event_id, CASE event_id % 5
         WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
         WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
         WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         WHEN 3 THEN strftime(ts, '%Y-%m-%d')
         ELSE 'day ' || strftime(ts, '%d') END AS written, ts FROM events)
       SELECT event_id, CASE WHEN event_id % 5 < 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         WHEN event_id % 5 = 3 THEN written || ' 00:00:00' ELSE written END AS shown
       FROM written""",
)
def format_timestamp(spark, sf_dir):
    text = F.rpad(F.col("ts").cast("string"), 26, "0")
    text = F.when(F.length(F.col("ts").cast("string")) > 19, text).otherwise(
        F.col("ts").cast("string")
    )
    number = F.col("event_id")
    written = (
        F.when(number % 5 == 0, F.concat(F.translate(text, " ", "T"), F.lit("Z")))
        .when(
            number % 5 == 1,
            F.concat(F.translate(F.substring(text, 1, 19), " ", "T"), F.lit("+02:00")),
        )
        .when(number % 5 == 2, F.substring(text, 1, 19))
        .when(number % 5 == 3, F.substring(text, 1, 10))
        .otherwise(F.concat(F.lit("day "), F.substring(text, 9, 2)))
    )
    events = testdata.table(spark, sf_dir, "events")
    return events.select("event_id", S.format_time(written).alias("shown"))


@query(
    "escape_markdown",
    "",
    r"SELECT doc_id, regexp_replace(text, '([\\*_`\[\]()#+\-.!])', '\\\1', 'g') AS escaped "
    "FROM documents",
)
def escape_markdown(spark, sf_dir):
    documents = testdata.table(spark, sf_dir, "documents")
    return documents.select("doc_id", S.escape_markdown(F.col("text")).alias("escaped"))


@query(
    "format_sources",
    "counted",
    """SELECT id, CAST(source_count AS VARCHAR) AS as_count, CASE WHEN source_count = 0 THEN '[]'
         ELSE '[' || repeat('"https://ex.org/a",', CAST(id % 4 AS INT)) || '"https://ex.org/b"]'
         END AS as_json FROM counted""",
)
def format_sources(spark, sf_dir):
    return with_parsed_sources(runs(spark, sf_dir)).select(
        "id",
        S.format_sources(F.col("sources")).alias("as_count"),
        S.format_sources(F.col("sources"), "json").alias("as_json"),
    )


BYTES_SQL = " ".join(
    f"WHEN size < {1024 ** (power + 1)} THEN format('{{:.1f}} {unit}', size / {1024.0**power})"
    for power, unit in enumerate(["B", "KB", "MB", "GB"])
)


@query(
    "format_bytes",
    "",
    "SELECT doc_id, CASE " + BYTES_SQL + " END AS shown FROM (SELECT doc_id, "
    "n_chars * (doc_id + 1) * (doc_id + 1) AS size FROM documents)",
)
def format_bytes(spark, sf_dir):
    size = F.col("n_chars") * (F.col("doc_id") + 1) * (F.col("doc_id") + 1)
    documents = testdata.table(spark, sf_dir, "documents")
    return documents.select("doc_id", S.format_bytes(size).alias("shown"))


KEY_SQL = """lower('result_' || strftime("timestamp", '%Y%m%d_%H%M%S') || '_' ||
  substring(md5(query), 1, 8) || coalesce('_' || regexp_replace(model, '[^\\p{L}\\p{N}]', '_',
  'g'), '') || '.json')"""


@query("export_key", "results", f"SELECT id, {KEY_SQL} AS export_key FROM results")
def export_key(spark, sf_dir):
    key = S.export_key(F.col("query"), F.col("timestamp"), F.col("model"))
    return runs(spark, sf_dir).select("id", key.alias("export_key"))


@query(
    "null_model_label",
    "results",
    "SELECT id, coalesce(nullif(model, ''), 'default') AS as_default, "
    "coalesce(nullif(model, ''), 'unknown') AS as_unknown FROM results",
)
def null_model_label(spark, sf_dir):
    labels = [S.model_label(F.col("model"), name).alias(f"as_{name}") for name in ("default", "unknown")]
    return runs(spark, sf_dir).select("id", *labels)


@query("success_case", "results", "SELECT id, CAST(success AS DOUBLE) AS success FROM results")
def success_case(spark, sf_dir):
    return runs(spark, sf_dir).select("id", S.success_number(F.col("success")).alias("success"))


OTHER_PROMPT = "event_type || ' topic ' || CAST(user_id AS VARCHAR)"


def _prompt_pairs(spark, sf_dir):
    prompt = F.concat("event_type", F.lit(" topic "), F.get_json_object("props", "$.k"))
    other = F.concat("event_type", F.lit(" topic "), F.col("user_id").cast("string"))
    events = testdata.table(spark, sf_dir, "events")
    return events.select("event_id", prompt.alias("prompt"), other.alias("other"))


@query(
    "positional_similarity",
    "",
    f"""WITH pairs AS (SELECT event_id, event_type || ' topic ' ||
          json_extract_string(props, '$.k') AS a, {OTHER_PROMPT} AS b FROM events)
        SELECT event_id, round(list_sum(list_transform(range(1, least(length(a), length(b)) + 1),
          lambda i: CAST(a[i] = b[i] AS INT))) / greatest(length(a), length(b)), 6) AS similarity
        FROM pairs""",
)
def positional_similarity(spark, sf_dir):
    similarity = S.positional_similarity(F.col("prompt"), F.col("other"))
    return _prompt_pairs(spark, sf_dir).select("event_id", similarity.alias("similarity"))


@query("sequence_ratio")
def sequence_ratio(spark, sf_dir):
    ratio = sequence_ratio_of()(F.col("prompt"), F.col("other"))
    return _prompt_pairs(spark, sf_dir).select("event_id", ratio.alias("ratio"))


# -- reads by id, distinct values, comparisons -----------------------------------------


@query(
    "semi_join_ids",
    "counted",
    rows_sql(
        "id IN (SELECT id FROM counted WHERE abs(execution_time_seconds - (SELECT "
        "avg(execution_time_seconds) FROM counted)) > 2 * (SELECT "
        "stddev_samp(execution_time_seconds) FROM counted))"
    ),
)
def semi_join_ids(spark, sf_dir):
    log = whole(spark, sf_dir)
    ids = distribution.outliers(log, deviations=2.0).select("id")
    return shown(log.join(ids, "id", "left_semi"))


@query(
    "anti_join_keepers",
    "counted",
    rows_sql(
        "id NOT IN (SELECT min(id) FROM counted GROUP BY query, model, CAST(\"timestamp\" AS DATE))"
    ).replace("%H:%M:%S", "00:00:00"),
)
def anti_join_keepers(spark, sf_dir):
    # Days in place of moments, so that equal triplets occur.
    day = F.col("timestamp").cast("date").cast("timestamp_ntz")
    log = whole(spark, sf_dir).withColumn("timestamp", day)
    first = log.groupBy("query", "model", "timestamp").agg(F.min("id").alias("id")).select("id")
    return shown(log.join(first, "id", "left_anti"))


@query("unique_queries", "results", "SELECT DISTINCT query FROM results")
def unique_queries(spark, sf_dir):
    return lookups.unique_queries(runs(spark, sf_dir))


@query("unique_models", "results", "SELECT DISTINCT model FROM results WHERE model IS NOT NULL")
def unique_models(spark, sf_dir):
    return lookups.unique_models(runs(spark, sf_dir))


@query(
    "compare_models_for_query",
    "counted",
    f"SELECT coalesce(nullif(model, ''), 'unknown') AS model_label, {ROW_COLUMNS} "
    f"FROM counted WHERE query = '{PROMPT}'",
)
def compare_models_for_query(spark, sf_dir):
    rows = lookups.compare_models(whole(spark, sf_dir), PROMPT)
    return shown(rows).withColumn("model_label", S.model_label(F.col("model"), "unknown"))


@query(
    "latest_per_model",
    "counted",
    f"""SELECT model_label, id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
          execution_time_seconds, coalesce(length(answer_text), 0) AS answer_length, source_count
        FROM (SELECT *, coalesce(model, 'unknown') AS model_label, row_number() OVER (PARTITION BY
          coalesce(model, 'unknown') ORDER BY "timestamp" DESC, id DESC) AS place FROM counted
          WHERE query = '{PROMPT}') WHERE place = 1""",
)
def latest_per_model(spark, sf_dir):
    latest = lookups.latest_per_model(testdata.results(spark, sf_dir), PROMPT)
    return latest.withColumn("timestamp", S.show_time(F.col("timestamp")))


# -- duplicates ------------------------------------------------------------------------


@query(
    "duplicate_queries_exact",
    "results",
    "SELECT query AS query_text, count(*) AS count FROM results GROUP BY query HAVING count(*) > 1",
)
def duplicate_queries_exact(spark, sf_dir):
    return dedup.duplicate_queries(runs(spark, sf_dir))


@query(
    "duplicate_groups",
    "results",
    "SELECT lower(query) AS group_query, count(*) AS count, count(DISTINCT model) AS model_count, "
    "min(id) AS first_id, max(id) AS last_id FROM results GROUP BY lower(query) HAVING count(*) > 1",
)
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(runs(spark, sf_dir), ignore_case=True)


@query(
    "duplicate_group_members",
    "results",
    "SELECT query AS group_query, id, model, count FROM (SELECT *, count(*) OVER (PARTITION BY "
    "query) AS count FROM results) WHERE count > 1",
)
def duplicate_group_members(spark, sf_dir):
    return dedup.duplicate_group_members(runs(spark, sf_dir))


@query(
    "duplicate_group_models",
    "results",
    "SELECT DISTINCT query AS group_query, model FROM results WHERE model IS NOT NULL AND query "
    "IN (SELECT query FROM results GROUP BY query HAVING count(*) > 1)",
)
def duplicate_group_models(spark, sf_dir):
    return dedup.duplicate_group_models(runs(spark, sf_dir))


KEEP_ORDER = {
    "latest": '"timestamp" DESC, id DESC',
    "earliest": '"timestamp", id',
    "best": "success DESC, execution_time_seconds ASC NULLS FIRST, id",
}


def _ranked(keep: str, columns: str, place: str) -> str:
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query, model ORDER BY "
        f"{KEEP_ORDER[keep]}) AS place FROM counted) WHERE place {place}"
    )


@query("dedup_keep_latest", "counted", _ranked("latest", ROW_COLUMNS, "= 1"))
def dedup_keep_latest(spark, sf_dir):
    return shown(dedup.deduplicate(whole(spark, sf_dir), "latest"))


@query("dedup_keep_earliest", "counted", _ranked("earliest", ROW_COLUMNS, "= 1"))
def dedup_keep_earliest(spark, sf_dir):
    return shown(dedup.deduplicate(whole(spark, sf_dir), "earliest"))


@query("dedup_keep_best", "counted", _ranked("best", ROW_COLUMNS, "= 1"))
def dedup_keep_best(spark, sf_dir):
    return shown(dedup.deduplicate(whole(spark, sf_dir), "best"))


@query("keep_policy", "counted", _ranked("best", "id", "= 1"))
def keep_policy(spark, sf_dir):
    return dedup.keepers(runs(spark, sf_dir), "best")


@query("dedup_dry_run", "counted", _ranked("latest", "id", "> 1"))
def dedup_dry_run(spark, sf_dir):
    return dedup.removable(runs(spark, sf_dir), "latest")


@query(
    "dedup_report",
    "results",
    "SELECT count(*) AS kept_count, CAST(sum(size - 1) AS BIGINT) AS removed_count FROM "
    "(SELECT count(*) AS size FROM results GROUP BY query, model)",
)
def dedup_report(spark, sf_dir):
    return dedup.removal_report(runs(spark, sf_dir))


@query(
    "dedup_exact_triplet",
    "counted",
    rows_sql(
        "id IN (SELECT min(id) FROM counted GROUP BY query, model, CAST(\"timestamp\" AS DATE))"
    ).replace("%H:%M:%S", "00:00:00"),
)
def dedup_exact_triplet(spark, sf_dir):
    # Days in place of moments, so that equal triplets occur.
    day = F.col("timestamp").cast("date").cast("timestamp_ntz")
    return shown(dedup.deduplicate_triplets(whole(spark, sf_dir).withColumn("timestamp", day)))
