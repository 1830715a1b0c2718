"""Registered extraction, ingestion, retention, export, similarity and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlog import schema
from answerlog.functions import scalars as S
from answerlog.operators import extract, retention, rollups, similarity, stability, timeseries
from answerlog.operators.aliases import MODEL_ALIASES, resolve_model
from answerlog.plans.base import ROW_COLUMNS, query, shown
from answerlog.plans.lookup_queries import KEY_SQL, PROMPT, runs, whole
from answerlog.plans.summary_queries import full
from answerlog.session import new_folder, with_number
from answerlog.sinks import exports, reports
from answerlog.sources import prompts, results, testdata
from answerlog.streaming import jobs
from answerlog.streaming.stability import stability_stream

SPLIT = "2024-01-16"
NL = "chr(10)"


# -- ingestion -------------------------------------------------------------------------


@query(
    "results_schema",
    "results",
    "SELECT model, true AS success, true AS has_time, count(*) AS count FROM results GROUP BY model",
)
def results_schema(spark, sf_dir):
    """Defaults of a batch that brings prompts and models only."""
    batch = schema.conform(runs(spark, sf_dir).select("id", "query", "model"))
    has_time = F.col("timestamp").isNotNull().alias("has_time")
    return batch.groupBy("model", "success", has_time).agg(F.count(F.lit(1)).alias("count"))


@query(
    "results_scan",
    "counted",
    f"SELECT {ROW_COLUMNS} FROM counted",
)
def results_scan(spark, sf_dir):
    """Whole runs, written and read back."""
    path = new_folder(spark, "scan")
    results.write_runs(schema.conform(whole(spark, sf_dir)), path)
    return shown(results.scan_results(spark, path))


@query(
    "results_append",
    "results",
    f""", numbered AS (SELECT *, row_number() OVER (ORDER BY "timestamp" >= TIMESTAMP '{SPLIT}',
          "timestamp", id) AS new_id FROM results)
        SELECT new_id AS id, query, model, strftime("timestamp", '%Y-%m-%d %H:%M:%S')
          AS "timestamp", md5(answer_text) AS answer_md5, error_message, success FROM numbered""",
)
def results_append(spark, sf_dir):
    """Two batches appended one after the other, then read back."""
    path = new_folder(spark, "append")
    old, new = retention.archive_split(whole(spark, sf_dir), SPLIT)
    for batch in (old, new):
        results.append_results(spark, batch, path)
    return results.scan_results(spark, path).select(
        "id",
        "query",
        "model",
        S.show_time(F.col("timestamp")).alias("timestamp"),
        F.md5("answer_text").alias("answer_md5"),
        "error_message",
        "success",
    )


CODE_SQL = """CASE WHEN json_type(raw) <> 'OBJECT' THEN 'not_an_object'
  WHEN json_type(raw, '$.query') IS NULL THEN 'query_missing'
  WHEN json_type(raw, '$.query') <> 'VARCHAR' THEN 'query_not_string'
  WHEN trim(json_extract_string(raw, '$.query')) = '' THEN 'query_empty'
  WHEN json_type(raw, '$.model') <> 'VARCHAR' THEN 'model_not_string'
  WHEN trim(json_extract_string(raw, '$.model')) NOT IN (%s) THEN 'model_unknown'
  WHEN json_type(raw, '$.no_screenshot') <> 'BOOLEAN' THEN 'no_screenshot_not_boolean'
  END""" % ", ".join(f"'{name}'" for name in MODEL_ALIASES)
CHECKED_SQL = f"""SELECT idx, {CODE_SQL} AS error_code,
  trim(json_extract_string(raw, '$.query')) AS query,
  trim(json_extract_string(raw, '$.model')) AS model FROM prompts"""


@query(
    "prompt_ingest",
    "prompts",
    f"SELECT error_code, query, model, count(*) AS count FROM (SELECT error_code, CASE WHEN "
    "error_code IS NULL THEN query END AS query, CASE WHEN error_code IS NULL THEN model END "
    f"AS model FROM ({CHECKED_SQL})) GROUP BY ALL",
)
def prompt_ingest(spark, sf_dir):
    """Prompts written as lines of JSON, read back and checked."""
    path = new_folder(spark, "prompts")
    testdata.prompts(spark, sf_dir).select("raw").write.text(path)
    checked = prompts.validate_prompts(prompts.read_prompt_lines(spark, path))
    return checked.groupBy("error_code", "query", "model").agg(F.count(F.lit(1)).alias("count"))


@query(
    "prompt_batches",
    "prompts",
    f"""SELECT 'entry' AS level, error_code, CASE WHEN error_code IS NULL THEN query END AS query,
          CASE WHEN error_code IS NULL THEN model END AS model, count(*) AS count
        FROM ({CHECKED_SQL}) GROUP BY ALL
        UNION ALL SELECT 'file', code, NULL, NULL, 1
          FROM (VALUES ('invalid_json'), ('not_an_array'), ('empty')) v(code)
        UNION ALL SELECT 'file', NULL, NULL, NULL, count(DISTINCT idx // 500) FROM prompts""",
)
def prompt_batches(spark, sf_dir):
    """Prompts written as files with a JSON array of up to 500 each, and three bad files."""
    path = new_folder(spark, "batches")
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "raw"))), lambda e: e["raw"]), ",")
    arrays = testdata.prompts(spark, sf_dir).groupBy(F.floor(F.col("idx") / 500)).agg(
        F.concat(F.lit("["), entries, F.lit("]")).alias("value")
    )
    bad = spark.createDataFrame([("not json",), ('{"query": "q"}',), ("[]",)], "value string")
    files = arrays.select("value").unionByName(bad)
    files.write.option("maxRecordsPerFile", 1).text(path)
    entries, read = prompts.split_prompt_arrays(spark, path)
    checked = prompts.validate_prompts(entries.select("idx", "raw"))
    none = F.lit(None).cast("string")
    counted = checked.groupBy(F.lit("entry").alias("level"), "error_code", "query", "model")
    of_files = read.groupBy(F.lit("file").alias("level"), "error_code", none.alias("query"), none.alias("model"))
    count = F.count(F.lit(1)).alias("count")
    return counted.agg(count).unionByName(of_files.agg(count))


@query(
    "prompt_validate",
    "prompts",
    f"SELECT idx, error_code, CASE WHEN error_code IS NULL THEN query END AS query, CASE WHEN "
    f"error_code IS NULL THEN model END AS model FROM ({CHECKED_SQL})",
)
def prompt_validate(spark, sf_dir):
    checked = prompts.validate_prompts(testdata.prompts(spark, sf_dir))
    return checked.select("idx", "error_code", "query", "model")


@query(
    "prompt_defaults",
    "prompts",
    f"SELECT idx, query, coalesce(model, 'grok-4') AS model, true AS no_screenshot "
    f"FROM ({CHECKED_SQL}) WHERE error_code IS NULL",
)
def prompt_defaults(spark, sf_dir):
    valid, _ = prompts.split_prompts(prompts.validate_prompts(testdata.prompts(spark, sf_dir)))
    filled = prompts.apply_defaults(valid, "grok-4", no_screenshot=True)
    return filled.select("idx", "query", "model", "no_screenshot")


TEST_ALIASES = {
    "zero": ["Model-0", "MODEL 0"],
    "any": ["model"],
    "three": ["The new Model-3"],
    "two": ["model-2", "2"],
}
ALIAS_SQL = ", ".join(
    f"({place}, '{name}', '{spelling.lower()}')"
    for place, (name, spelling) in enumerate(
        (name, spelling) for name, spellings in TEST_ALIASES.items() for spelling in spellings
    )
)
ALIAS_SQL = f"""aliases(place, canonical, spelling) AS (VALUES {ALIAS_SQL}),
  labels AS (SELECT DISTINCT model FROM results),
  resolved AS (SELECT l.model, (SELECT a.canonical FROM aliases a
      WHERE l.model <> '' AND (contains(lower(l.model), a.spelling)
                               OR contains(a.spelling, lower(l.model)))
      ORDER BY lower(l.model) <> a.spelling, -length(a.spelling), a.place LIMIT 1) AS canonical
    FROM labels l)"""


@query(
    "model_alias_resolve",
    "results",
    f", {ALIAS_SQL} SELECT r.id, r.model, x.canonical FROM results r LEFT JOIN resolved x ON "
    "x.model = r.model",
)
def model_alias_resolve(spark, sf_dir):
    canonical = resolve_model(F.col("model"), TEST_ALIASES)
    return runs(spark, sf_dir).select("id", "model", canonical.alias("canonical"))


@query(
    "alias_theta_join",
    "results",
    f", {ALIAS_SQL} SELECT x.canonical, count(*) AS count FROM results r LEFT JOIN resolved x ON "
    "x.model = r.model GROUP BY 1",
)
def alias_theta_join(spark, sf_dir):
    canonical = resolve_model(F.col("model"), TEST_ALIASES)
    return (
        runs(spark, sf_dir)
        .groupBy(canonical.alias("canonical"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


# -- extraction ------------------------------------------------------------------------


def _start_sql() -> str:
    cases = " ".join(
        f"WHEN strpos(lower(full_text), '{marker}') > 1 THEN strpos(lower(full_text), '{marker}') "
        f"+ {len(marker)}"
        for marker in extract.START_MARKERS
    )
    return f"CASE {cases} ELSE 0 END"


def _end_sql() -> str:
    """Place of the nearest end marker behind the start; only used where there is a start."""
    found = ", ".join(
        f"CASE WHEN strpos(substring(lower(full_text), s), '{marker}') > 0 THEN "
        f"strpos(substring(lower(full_text), s), '{marker}') + s - 1 END"
        for marker in extract.END_MARKERS
    )
    return f"least(length(full_text) + 1, {found})"


def _strip_sql(text: str) -> str:
    return f"trim({text}, '{S.WHITE_SPACE}')"


def _marked_sql() -> str:
    body = _strip_sql("substring(full_text, s, e - s)")
    for phrase in extract.UI_PHRASES:
        body = f"replace({body}, '{phrase}', '')"
    return f"CASE WHEN s > 0 AND s < e THEN {_strip_sql(body)} ELSE '' END"


def _clean_sql() -> str:
    skip = " OR ".join(f"contains(x, '{phrase}')" for phrase in extract.SKIP_PHRASES)
    return f"""CASE WHEN length(full_text) > 200 THEN array_to_string(list_filter(list_transform(
        string_split(full_text, {NL}), lambda x: {_strip_sql('x')}),
        lambda x: x <> '' AND NOT ({skip})), {NL}) ELSE '' END"""


EXTRACT_SQL = f""", placed AS (SELECT *, {_start_sql()} AS s FROM page_text),
  ended AS (SELECT *, {_end_sql()} AS e FROM placed),
  tried AS (SELECT page_id, {_marked_sql()} AS marked, {_clean_sql()} AS clean FROM ended),
  extracted AS (SELECT page_id, marked <> '' OR clean <> '' AS success,
    coalesce(nullif(marked, ''), nullif(clean, ''), '{extract.NO_ANSWER}') AS answer_text,
    CASE WHEN marked <> '' THEN '{extract.MARKERS}' WHEN clean <> '' THEN '{extract.CLEAN}' END
      AS strategy_used,
    CASE WHEN marked = '' AND clean = '' THEN '{extract.ALL_FAILED}' END AS error FROM tried)"""


@query(
    "extract_answer_markers",
    "page_text",
    f"{EXTRACT_SQL} SELECT page_id, marked AS answer FROM tried",
)
def extract_answer_markers(spark, sf_dir):
    return extract.with_marked_answer(testdata.page_text(spark, sf_dir)).select("page_id", "answer")


@query(
    "extract_answer_clean",
    "page_text",
    f"{EXTRACT_SQL} SELECT page_id, clean AS answer FROM tried",
)
def extract_answer_clean(spark, sf_dir):
    answer = extract.answer_clean_lines(F.col("full_text"))
    return testdata.page_text(spark, sf_dir).select("page_id", answer.alias("answer"))


def _html_text_sql(html: str) -> str:
    text = html
    for pattern, by in [
        (r"(?is)<script\b.*?</script>", " "),
        (r"(?is)<style\b.*?</style>", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"<[^>]*>", " "),
    ]:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
        text = f"replace({text}, '{entity}', '{char}')"
    return _strip_sql(rf"regexp_replace({text}, '\s+', ' ', 'g')")


@query(
    "extract_answer_container",
    "",
    f"""SELECT page_id, CASE WHEN length(t) > 50 THEN t ELSE '' END AS answer FROM (SELECT page_id,
        {_html_text_sql("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS t
        FROM pages)""",
)
def extract_answer_container(spark, sf_dir):
    pages = testdata.table(spark, sf_dir, "pages")
    return pages.select("page_id", extract.answer_container(F.col("html")).alias("answer"))


def _boxed_sql() -> str:
    article = _html_text_sql("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")
    return f"""boxed AS (SELECT t.*, CASE WHEN marked = '' AND clean = '' AND length({article}) > 50
      THEN {article} ELSE '' END AS box FROM tried t LEFT JOIN pages p
      ON p.page_id = t.page_id % (SELECT count(*) FROM pages))"""


@query(
    "extract_answer",
    "page_text",
    f"""{EXTRACT_SQL}, {_boxed_sql()}
      SELECT page_id, marked <> '' OR clean <> '' OR box <> '' AS success,
        coalesce(nullif(marked, ''), nullif(clean, ''), nullif(box, ''), '{extract.NO_ANSWER}') AS answer_text,
        CASE WHEN marked <> '' THEN '{extract.MARKERS}' WHEN clean <> '' THEN '{extract.CLEAN}'
          WHEN box <> '' THEN '{extract.CONTAINER}' END AS strategy_used,
        CASE WHEN marked = '' AND clean = '' AND box = '' THEN '{extract.ALL_FAILED}' END AS error
      FROM boxed""",
)
def extract_answer(spark, sf_dir):
    """All three steps: each text with the page of its number around it."""
    pages = testdata.table(spark, sf_dir, "pages").select(F.col("page_id").alias("_page"), "html")
    count = pages.agg(F.count(F.lit(1))).scalar()
    texts = testdata.page_text(spark, sf_dir)
    both = texts.join(pages, F.col("page_id") % count == F.col("_page"), "left").drop("_page")
    return extract.extract_answers(both)


def _message_sql() -> str:
    cases = [
        "WHEN length(a) < 20 THEN 'Answer too short (' || CAST(length(a) AS VARCHAR) || ' chars)'"
    ]
    for pattern in extract.ERROR_PATTERNS:
        quoted = pattern.replace("'", "''")
        found = f"regexp_extract(a, '(?i)({quoted})', 1)"
        cases.append(
            f"WHEN {found} <> '' THEN 'Error message detected: ''' || {found} || ''' matched "
            f"pattern {quoted}'"
        )
    cases.append("WHEN page_id % 3 = 1 THEN 'No valid source URLs found (got 1 sources)'")
    return "CASE " + " ".join(cases) + " END"


@query(
    "validate_extraction",
    "page_text",
    f"{EXTRACT_SQL} SELECT page_id, message IS NULL AS valid, message FROM (SELECT page_id, "
    f"{_message_sql()} AS message FROM (SELECT page_id, answer_text AS a FROM extracted))",
)
def validate_extraction(spark, sf_dir):
    """With no link, one without a web url, or two of which one has it."""
    found = extract.extract_answers(testdata.page_text(spark, sf_dir))
    link = lambda url: F.struct(F.lit(url).alias("url"), F.lit("t").alias("text"))
    number = F.col("page_id") % 3
    links = F.when(number == 1, F.array(link("ftp://a"))).when(
        number == 2, F.array(link("ftp://a"), link("https://b"))
    ).otherwise(F.array().cast("array<struct<url:string,text:string>>"))
    message = extract.validation_error(F.col("answer_text"), links)
    return found.select("page_id", message.alias("message")).select(
        "page_id", F.col("message").isNull().alias("valid"), "message"
    )


EXCLUDED = ["casino", "free-bets"]


def _harvest_sql(threshold: int, cap: int | None) -> str:
    kept = f" WHERE citation_number <= {cap}" if cap else ""
    return f""", sound AS (SELECT result_id, url, text, tier, position FROM citations WHERE
        regexp_matches(url, '^https?://') AND NOT contains(lower(url), 'casino') AND NOT
        contains(lower(url), 'free-bets') AND length(text) >= 3),
      once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id, url
        ORDER BY tier, position) AS r FROM sound) WHERE r = 1),
      counted AS (SELECT *, count(*) FILTER (WHERE tier = 1) OVER (PARTITION BY result_id) AS n1,
        count(*) FILTER (WHERE tier <= 2) OVER (PARTITION BY result_id) AS n2 FROM once),
      used AS (SELECT * FROM counted WHERE tier = 1 OR (tier = 2 AND n1 < {threshold})
        OR (tier = 3 AND n1 < {threshold} AND n2 < {threshold}))
      SELECT result_id, url, text, regexp_replace(regexp_extract(url,
        '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\\.', '') AS domain,
        citation_number FROM (SELECT *, CAST(row_number() OVER (PARTITION BY result_id
        ORDER BY tier, position) AS INT) AS citation_number FROM used){kept}"""


def _harvest(spark, sf_dir, threshold, cap):
    links = extract.harvest_citations(testdata.citations(spark, sf_dir), EXCLUDED, threshold, cap)
    return links.drop("title", "snippet")


@query("harvest_citations", "citations", _harvest_sql(3, None))
def harvest_citations(spark, sf_dir):
    return _harvest(spark, sf_dir, 3, None)


@query("citation_numbering", "citations", _harvest_sql(2, 3))
def citation_numbering(spark, sf_dir):
    """The same with a low threshold and cap, so that both take effect."""
    return _harvest(spark, sf_dir, 2, 3)


@query(
    "page_link_inventory",
    "",
    rf"""WITH anchors AS (SELECT page_id, list_zip(range(1, len(a) + 1), a) AS z FROM (SELECT
          page_id, regexp_extract_all(html, '(?is)(<a\s[^>]*>.*?</a>)', 1) AS a FROM pages)),
        each AS (SELECT page_id, unnest(z) AS u FROM anchors),
        read AS (SELECT page_id, CAST(u[1] AS INT) AS position, u[2] AS anchor,
          {_strip_sql("regexp_extract(u[2], '(?is)^<a\\s([^>]*)>', 1)")} AS attributes FROM each)
        SELECT page_id, position, regexp_extract(attributes,
          '(?i)(?:^|\s)href=["'']([^"'']*)["'']', 1) AS href, {_html_text_sql("anchor")} AS text,
          attributes FROM read WHERE regexp_extract(attributes,
          '(?i)(?:^|\s)href=["'']([^"'']*)["'']', 1) <> ''""",
)
def page_link_inventory(spark, sf_dir):
    return extract.page_links(testdata.table(spark, sf_dir, "pages"))


@query(
    "url_quality",
    "counted",
    "SELECT id, source_count AS web_urls, source_count AS all_urls FROM counted",
)
def url_quality(spark, sf_dir):
    parsed = results.with_parsed_sources(runs(spark, sf_dir))
    return parsed.select(
        "id",
        S.web_url_count(F.col("sources")).alias("web_urls"),
        F.size("sources").cast("long").alias("all_urls"),
    )


@query(
    "display_numbering",
    "counted",
    """SELECT id, CAST(i AS INT) AS number, CASE WHEN i = source_count THEN 'https://ex.org/b' ELSE
         'https://ex.org/a' END AS url FROM (SELECT id, source_count, unnest(range(1,
         source_count + 1)) AS i FROM counted)""",
)
def display_numbering(spark, sf_dir):
    links = extract.link_list(results.with_parsed_sources(runs(spark, sf_dir)))
    return links.select("id", "number", "url")


STABILITY_SQL = """, lagged AS (SELECT entity_id, seq, length(text) AS n, length(text) >= 50 AND
      text = lag(text) OVER (PARTITION BY entity_id ORDER BY seq) AS same FROM snapshots),
    marked AS (SELECT *, same AND coalesce(lag(same, 1) OVER w, false) AND
      coalesce(lag(same, 2) OVER w, false) AS stable FROM lagged
      WINDOW w AS (PARTITION BY entity_id ORDER BY seq)),
    summed AS (SELECT entity_id, count(*) AS checks, coalesce(bool_or(stable), false) AS stable,
      CAST(min(seq) FILTER (WHERE stable) AS BIGINT) AS stable_seq,
      CAST(arg_min(n, seq) FILTER (WHERE stable) AS BIGINT) AS stable_length
      FROM marked GROUP BY entity_id)"""


@query("content_stability", "snapshots", f"{STABILITY_SQL} SELECT * FROM summed")
def content_stability(spark, sf_dir):
    documents = testdata.table(spark, sf_dir, "documents")
    return stability.content_stability(testdata.snapshots_of(documents))


# -- retention -------------------------------------------------------------------------


@query(
    "archive_split",
    "counted",
    f"SELECT CASE WHEN \"timestamp\" < TIMESTAMP '{SPLIT}' THEN 'archive' ELSE 'main' END AS part, "
    f"{ROW_COLUMNS} FROM counted",
)
def archive_split(spark, sf_dir):
    old, rest = retention.archive_split(whole(spark, sf_dir), SPLIT)
    parts = [shown(rows).select(F.lit(name).alias("part"), "*") for name, rows in [("archive", old), ("main", rest)]]
    return parts[0].unionByName(parts[1])


@query(
    "delete_failed",
    "counted",
    f"SELECT {ROW_COLUMNS} FROM counted WHERE NOT (NOT success AND \"timestamp\" < TIMESTAMP "
    f"'{SPLIT}')",
)
def delete_failed(spark, sf_dir):
    return shown(retention.without_failed(whole(spark, sf_dir), SPLIT))


@query(
    "archive_failed_before",
    "counted",
    f"SELECT {ROW_COLUMNS} FROM counted WHERE NOT success AND \"timestamp\" < TIMESTAMP '{SPLIT}'",
)
def archive_failed_before(spark, sf_dir):
    return shown(retention.failed_runs(whole(spark, sf_dir), SPLIT))


@query("snapshot_backup", "counted", f"SELECT {ROW_COLUMNS} FROM counted")
def snapshot_backup(spark, sf_dir):
    """The rows of a snapshot, read from its files."""
    path = new_folder(spark, "backup")
    retention.write_snapshot(whole(spark, sf_dir), path)
    return shown(spark.read.schema(schema.RESULTS).parquet(path))


@query("snapshot_restore", "counted", f"SELECT {ROW_COLUMNS} FROM counted")
def snapshot_restore(spark, sf_dir):
    path, target = new_folder(spark, "backup"), new_folder(spark, "restored")
    retention.write_snapshot(whole(spark, sf_dir), path)
    retention.restore_snapshot(spark, path, target)
    return shown(spark.read.schema(schema.RESULTS).parquet(target))


@query(
    "table_health",
    "",
    "SELECT count(*) AS records, count(*) > 10000 AS archive_advised FROM events",
)
def table_health(spark, sf_dir):
    health = retention.table_health(spark, f"{sf_dir}/events.parquet")
    return health.select("records", "archive_advised")


# -- exports ---------------------------------------------------------------------------


@query(
    "export_csv",
    "counted",
    """SELECT id, query, coalesce(nullif(model, ''), 'unknown') AS model,
         strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
         coalesce(answer_text, '') AS answer_text, CAST(source_count AS VARCHAR) AS sources,
         coalesce(execution_time_seconds, 0) AS execution_time_seconds, success
       FROM counted WHERE success AND contains(lower(query), 'topic 1')""",
)
def export_csv(spark, sf_dir):
    """Written as CSV and read back."""
    path = new_folder(spark, "export") + ".csv"
    filters = {"success": True, "query_pattern": "topic 1"}
    exports.export_csv(full(spark, sf_dir), path, filters)
    types = (
        "id long, query string, model string, timestamp string, answer_text string, "
        "sources string, execution_time_seconds double, success boolean"
    )
    reader = spark.read.schema(types).option("header", True).option("multiLine", True)
    back = reader.option("escape", '"').option("nullValue", "\x00").csv(path)
    return back.withColumn("answer_text", F.coalesce("answer_text", F.lit("")))


@query(
    "export_csv_cli",
    "counted",
    """SELECT id, query, coalesce(nullif(model, ''), 'default') AS model,
         strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", success,
         execution_time_seconds, CAST(coalesce(length(answer_text), 0) AS BIGINT) AS answer_length,
         source_count FROM counted""",
)
def export_csv_cli(spark, sf_dir):
    rows = exports.csv_report_rows(full(spark, sf_dir), include_sources=True)
    return rows.withColumn("timestamp", S.show_time(F.col("timestamp")))


READ_BACK = (
    "id long, query string, model string, timestamp timestamp_ntz, answer_text string, "
    "sources array<struct<url string, text string>>, execution_time_seconds double, "
    "success boolean, error_message string"
)
JSON_SQL = f"""id, query, model, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
  md5(answer_text) AS answer_md5, source_count, execution_time_seconds, success, error_message"""


def _from_json(rows, *more):
    """Runs as they were read from exported JSON."""
    return rows.select(
        *more,
        "id",
        "query",
        "model",
        S.show_time(F.col("timestamp")).alias("timestamp"),
        F.md5("answer_text").alias("answer_md5"),
        F.size("sources").cast("long").alias("source_count"),
        "execution_time_seconds",
        "success",
        "error_message",
    )


@query("export_json", "counted", f"SELECT {JSON_SQL} FROM counted WHERE model = 'model-1'")
def export_json(spark, sf_dir):
    """All runs of a model, written as JSON lines and read back."""
    path = new_folder(spark, "export")
    exports.export_json(whole(spark, sf_dir), path, model="model-1")
    return _from_json(spark.read.schema(READ_BACK).json(path))


@query(
    "export_json_per_result",
    "counted",
    f"SELECT {KEY_SQL} AS key, {JSON_SQL} FROM counted",
)
def export_json_per_result(spark, sf_dir):
    documents = exports.json_documents(results.with_parsed_sources(whole(spark, sf_dir)))
    run = F.from_json("document", READ_BACK).alias("run")
    return _from_json(documents.select("key", run).select("key", "run.*"), "key")


LINKS_SQL = f"""array_to_string(list_transform(range(1, source_count + 1), lambda i:
  CAST(i AS VARCHAR) || '. ' || CASE WHEN i = source_count THEN '[t](https://ex.org/b)'
  ELSE '[s](https://ex.org/a)' END), {NL})"""


BLOCK_SQL = rf"""'### Query: "' || query || '"' || {NL} || {NL} || {NL} ||
      '- **Model**: ' || coalesce(nullif(model, ''), 'unknown') || {NL} ||
      '- **Timestamp**: ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || {NL} ||
      '- **Execution Time**: ' || format('{{:.1f}}', coalesce(execution_time_seconds, 0)) || 's'
      || {NL} || '- **Success**: ' || CASE WHEN success THEN '✓' ELSE '✗' END || {NL} || {NL} ||
      '**Answer**:' || {NL} || {NL} || coalesce(answer_text, '') || {NL} || {NL} ||
      CASE WHEN source_count > 0 THEN '**Sources**:' || {NL} || {NL} || {LINKS_SQL} || {NL} || {NL}
        ELSE '' END || '---' || {NL}"""


@query("render_markdown", "counted", f"SELECT id, {BLOCK_SQL} AS block FROM counted")
def render_markdown(spark, sf_dir):
    parsed = results.with_parsed_sources(full(spark, sf_dir))
    return parsed.select("id", reports.markdown_block().alias("block"))


@query(
    "export_md_cli",
    "counted",
    f"""SELECT number, '## Result ' || CAST(number AS VARCHAR) || {NL} || {NL} ||
      '**Query:** ' || query || {NL} || {NL} ||
      '**Model:** ' || coalesce(nullif(model, ''), 'default') || {NL} || {NL} ||
      '**Timestamp:** ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || {NL} || {NL} ||
      '**Status:** ' || CASE WHEN success THEN 'Success' ELSE 'Failed' END || {NL} || {NL} ||
      '**Execution Time:** ' || format('{{:.2f}}', coalesce(execution_time_seconds, 0)) || 's' ||
      {NL} || {NL} || CASE WHEN coalesce(answer_text, '') <> '' THEN '### Answer' || {NL} || {NL} ||
        answer_text || {NL} || {NL} ELSE '' END ||
      CASE WHEN source_count > 0 THEN '### Sources' || {NL} || {NL} ||
        array_to_string(list_transform(range(1, source_count + 1), lambda i: CASE WHEN
          i = source_count THEN '- [t](https://ex.org/b)' ELSE '- [s](https://ex.org/a)' END), {NL})
        || {NL} || {NL} ELSE '' END || '---' || {NL} AS section
      FROM (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS number
            FROM counted)""",
)
def export_md_cli(spark, sf_dir):
    numbered = with_number(full(spark, sf_dir), ["timestamp", "id"], "number", 1, descending=True)
    parsed = results.with_parsed_sources(numbered)
    return parsed.select("number", reports.report_block().alias("section"))


@query(
    "print_result",
    "counted",
    f"""SELECT id, repeat('=', 80) || {NL} || 'ID: ' || CAST(id AS VARCHAR) || {NL} || 'Query: ' ||
      query || {NL} || 'Model: ' || coalesce(nullif(model, ''), 'default') || {NL} ||
      'Timestamp: ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || {NL} || 'Execution Time: ' ||
      format('{{:.2f}}', coalesce(execution_time_seconds, 0)) || 's' || {NL} || 'Success: ' ||
      CASE WHEN success THEN '✓' ELSE '✗' || {NL} || 'Error: ' || error_message END || {NL} ||
      {NL} || 'Answer (' || CAST(coalesce(length(answer_text), 0) AS VARCHAR) || ' chars):' ||
      {NL} || repeat('-', 80) || {NL} || coalesce(answer_text, '') ||
      CASE WHEN source_count > 0 THEN {NL} || {NL} || 'Sources (' ||
        CAST(source_count AS VARCHAR) || '):' || {NL} || repeat('-', 80) || {NL} ||
        array_to_string(list_transform(range(1, source_count + 1), lambda i: CAST(i AS VARCHAR) ||
          CASE WHEN i = source_count THEN '. t [ex.org]' || {NL} || '   https://ex.org/b'
          ELSE '. s [ex.org]' || {NL} || '   https://ex.org/a' END || {NL}), {NL})
        ELSE '' END AS text FROM counted""",
)
def print_result(spark, sf_dir):
    parsed = results.with_parsed_sources(full(spark, sf_dir))
    return parsed.select("id", reports.display_text().alias("text"))


@query(
    "markdown_table",
    "results",
    """, rows AS (SELECT '| ' || model || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS line,
         row_number() OVER (ORDER BY model) + 1 AS place FROM results WHERE model IS NOT NULL
         GROUP BY model)
       SELECT CAST(0 AS BIGINT) AS place, '| Model | Count |' AS line UNION ALL
       SELECT 1, '| --- | --- |' UNION ALL SELECT place, line FROM rows""",
)
def markdown_table(spark, sf_dir):
    counts = rollups.summary_by_model(runs(spark, sf_dir))
    return reports.markdown_table(counts, {"model": "Model", "count": "Count"}, ["model"])


GENERATED = "2024-02-01 08:00:00"


def _table_sql(titles: str, line: str, source: str, order: str) -> str:
    """Lines of a Markdown table: places from 0 on."""
    count = titles.count("|") - 1
    rule = "| " + " | ".join(["---"] * count) + " |"
    return f"""SELECT CAST(0 AS BIGINT) AS place, '{titles}' AS line UNION ALL SELECT 1, '{rule}'
      UNION ALL SELECT row_number() OVER (ORDER BY {order}) + 1, {line} FROM ({source})"""


def _model_rows_sql(model: str, where: str) -> str:
    return f"""SELECT {model} AS model, count(*) AS n,
      sum(coalesce(execution_time_seconds, 0)) / count(*) AS mean,
      CAST(round_even(count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*), 0) AS BIGINT) AS rate
      FROM counted WHERE {where} GROUP BY 1"""


COMPARED = f"query = '{PROMPT}'"
LABEL = "coalesce(nullif(model, ''), 'unknown')"


@query(
    "comparison_report",
    "counted",
    f""", asked AS (SELECT *, {LABEL} AS label FROM counted WHERE {COMPARED}),
      head AS (SELECT ['# Model Comparison' || {NL}, 'Query: "{PROMPT}"' || {NL},
        'Generated: {GENERATED}' || {NL},
        'Models Compared: ' || count(DISTINCT label) || {NL} || {NL},
        'Total Results: ' || count(*) || {NL} || {NL}, '## Comparison Table' || {NL}] AS lines FROM asked),
      models AS ({_table_sql(
          "| Model | Count | Avg Execution Time | Success Rate |",
          "'| ' || model || ' | ' || n || ' | ' || format('{:.1f}', mean) || 's | ' || rate || '% |'",
          _model_rows_sql(LABEL, COMPARED), "model")}),
      numbered AS (SELECT *, row_number() OVER (ORDER BY label, "timestamp" DESC, id DESC) - 1 AS place,
        row_number() OVER (PARTITION BY label ORDER BY "timestamp" DESC, id DESC) AS number,
        count(*) OVER (PARTITION BY label) AS runs FROM asked)
      SELECT 0 AS section, generate_subscripts(lines, 1) - 1 AS place, unnest(lines) AS line FROM head
      UNION ALL SELECT 1, place, line FROM models
      UNION ALL SELECT 2, 0, {NL} || '## Detailed Results' || {NL}
      UNION ALL SELECT 3, place, CASE WHEN number = 1 THEN '### ' || label || {NL} || 'Results: ' || runs
          || {NL} || {NL} ELSE '' END || '#### Result ' || number || {NL} || {NL} ||
        '- **Timestamp**: ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || {NL} ||
        '- **Execution Time**: ' || format('{{:.1f}}', coalesce(execution_time_seconds, 0)) || 's' || {NL} ||
        '- **Success**: ' || CASE WHEN success THEN '✓' ELSE '✗' END || {NL} || {NL} ||
        coalesce(answer_text, '') || {NL} FROM numbered""",
)
def comparison_report(spark, sf_dir):
    return reports.comparison_report(full(spark, sf_dir), PROMPT, generated=GENERATED)


@query(
    "summary_report",
    "counted",
    f""", t AS (SELECT count(*) AS n, sum(execution_time_seconds) AS time,
        count(*) FILTER (WHERE success) AS good, CAST(sum(source_count) AS BIGINT) AS links,
        CAST(sum(length(answer_text)) AS BIGINT) AS chars, count(DISTINCT query) AS queries,
        count(DISTINCT model) AS models FROM counted),
      head AS (SELECT ['# Database Summary' || {NL}, 'Generated: {GENERATED}' || {NL} || {NL},
        '## Overview' || {NL}, '- **Total Results**: ' || n, '- **Unique Queries**: ' || queries,
        '- **Unique Models**: ' || models || {NL}, '## Performance Statistics' || {NL},
        '- **Total Execution Time**: ' || format('{{:.1f}}', time) || 's',
        '- **Average Execution Time**: ' || format('{{:.1f}}', time / n) || 's',
        '- **Success Rate**: ' || format('{{:.1f}}', good * 100.0::DOUBLE / n) || '%',
        '- **Successful Results**: ' || good || '/' || n || {NL}, '## Content Statistics' || {NL},
        '- **Total Sources**: ' || links,
        '- **Average Sources per Result**: ' || format('{{:.1f}}', links / n),
        '- **Total Answer Characters**: ' || chars,
        '- **Average Answer Length**: ' || CAST(round_even(chars / n, 0) AS BIGINT) || ' characters' || {NL},
        '## Model Summary' || {NL}] AS lines FROM t),
      models AS ({_table_sql(
          "| Model | Count | Success Rate | Avg Time |",
          "'| ' || model || ' | ' || n || ' | ' || rate || '% | ' || format('{:.1f}', mean) || 's |'",
          _model_rows_sql("model", "model IS NOT NULL"), "model")}),
      prompts AS ({_table_sql(
          "| Query | Count |", "'| ' || query || ' | ' || n || ' |'",
          "SELECT query, count(*) AS n FROM counted GROUP BY query", "query")})
      SELECT 0 AS section, generate_subscripts(lines, 1) - 1 AS place, unnest(lines) AS line FROM head
      UNION ALL SELECT 1, place, line FROM models
      UNION ALL SELECT 2, 0, {NL} || '## Top Queries' || {NL}
      UNION ALL SELECT 3, place, line FROM prompts""",
)
def summary_report(spark, sf_dir):
    return reports.summary_report(full(spark, sf_dir), generated=GENERATED)


@query(
    "export_by_model",
    "counted",
    f"""SELECT regexp_replace(model, '[^a-z0-9]', '_', 'g') AS group_key, {JSON_SQL}
        FROM counted WHERE model IS NOT NULL""",
)
def export_by_model(spark, sf_dir):
    """Runs as the files of the groups hold them."""
    path = new_folder(spark, "by-model")
    exports.export_groups(exports.model_groups(whole(spark, sf_dir)), path, "json")
    return _from_json(spark.read.schema(f"{READ_BACK}, group_key string").json(path), "group_key")


@query(
    "export_by_period",
    "counted",
    """SELECT strftime("timestamp", '%Y-W%V') AS group_key, id, query,
         coalesce(nullif(model, ''), 'unknown') AS model, md5(coalesce(answer_text, '')) AS answer_md5,
         CAST(source_count AS VARCHAR) AS sources, success FROM counted""",
)
def export_by_period(spark, sf_dir):
    path = new_folder(spark, "by-week")
    exports.export_groups(exports.period_groups(whole(spark, sf_dir), "week"), path, "csv")
    return exports.read_groups(spark, path, "csv").select(
        "group_key",
        F.col("id").cast("long").alias("id"),
        "query",
        "model",
        F.md5(F.coalesce("answer_text", F.lit(""))).alias("answer_md5"),
        "sources",
        (F.col("success") == "true").alias("success"),
    )


@query(
    "export_batch_cli",
    "counted",
    f"""SELECT strftime("timestamp", '%Y-%m-%d') AS group_key, md5({BLOCK_SQL}) AS block_md5
        FROM counted""",
)
def export_batch_cli(spark, sf_dir):
    path = new_folder(spark, "by-date")
    exports.export_groups(exports.label_groups(whole(spark, sf_dir), "date"), path, "md")
    blocks = exports.read_groups(spark, path, "md")
    return blocks.select("group_key", F.md5("value").alias("block_md5"))


@query(
    "export_manifest",
    "results",
    "SELECT coalesce(model, 'default') AS group_key, count(*) AS record_count FROM results GROUP BY 1",
)
def export_manifest(spark, sf_dir):
    """Counts of what the files hold."""
    path = new_folder(spark, "manifest")
    written = exports.export_groups(exports.label_groups(whole(spark, sf_dir)), path, "json")
    return written.filter("files > 0 AND bytes > 0").select("group_key", "record_count")


# -- similarity ------------------------------------------------------------------------

SIMILAR_AT = 0.9

# Prompts in ascending order against the leaders so far, one prompt per step.
GREEDY_SQL = f"""WITH RECURSIVE results AS (%s),
  prompts AS (SELECT query, row_number() OVER (ORDER BY query) AS i
    FROM (SELECT DISTINCT query FROM results)),
  walk(i, query, leaders, leader) AS (
    SELECT CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR)
    UNION ALL
    SELECT p.i, p.query, CASE WHEN f.leader IS NULL THEN list_append(w.leaders, p.query)
      ELSE w.leaders END, f.leader
    FROM walk w JOIN prompts p ON p.i = w.i + 1, LATERAL (SELECT list_filter(w.leaders, lambda l:
      list_sum(list_transform(range(1, least(length(l), length(p.query)) + 1), lambda k:
        CAST(lower(l)[k] = lower(p.query)[k] AS INT))) / greatest(length(l), length(p.query))
      >= {SIMILAR_AT})[1] AS leader) f),
  pairs AS (SELECT leader AS query_text, query AS similar_query,
    round(list_sum(list_transform(range(1, least(length(leader), length(query)) + 1), lambda k:
      CAST(lower(leader)[k] = lower(query)[k] AS INT))) / greatest(length(leader), length(query)), 6)
      AS similarity
    FROM walk WHERE leader IS NOT NULL)"""


def _greedy(body: str) -> str:
    from answerlog.plans.base import VIEWS

    return GREEDY_SQL.replace("%s", VIEWS["results"]) + body


@query("similar_query_pairs", "", _greedy("SELECT * FROM pairs"))
def similar_query_pairs(spark, sf_dir):
    return similarity.similar_queries(runs(spark, sf_dir), SIMILAR_AT)


@query(
    "duplicate_queries_fuzzy",
    "",
    _greedy(
        "SELECT query_text, count(*) OVER (PARTITION BY query_text) + 1 AS count, similar_query "
        "FROM pairs"
    ),
)
def duplicate_queries_fuzzy(spark, sf_dir):
    return similarity.fuzzy_groups(runs(spark, sf_dir), SIMILAR_AT)


@query("sequence_similar_pairs")
def sequence_similar_pairs(spark, sf_dir):
    return similarity.sequence_similar(runs(spark, sf_dir))


# -- streaming -------------------------------------------------------------------------


def _drained(writer, spark, name: str) -> None:
    """Run a stream over everything that is there, then stop."""
    stream = (
        writer.option("checkpointLocation", new_folder(spark, name))
        .trigger(availableNow=True)
        .start()
    )
    try:
        if not stream.awaitTermination(1800):
            raise TimeoutError(f"stream {name} did not end")
    finally:
        stream.stop()


@query(
    "stream_append_results",
    "counted",
    f"SELECT {ROW_COLUMNS} FROM counted",
)
def stream_append_results(spark, sf_dir):
    path = new_folder(spark, "stream-log")
    arriving = testdata.results_of(testdata.stream_table(spark, sf_dir, "events"))
    arriving = testdata.with_answers(arriving, testdata.table(spark, sf_dir, "documents"))
    _drained(jobs.append_stream(arriving, path), spark, "append-stream")
    return shown(results.scan_results(spark, path))


@query(
    "stream_content_stability",
    "snapshots",
    f"{STABILITY_SQL} SELECT entity_id, checks, stable, stable_seq, stable_length FROM summed",
)
def stream_content_stability(spark, sf_dir):
    """All texts, from the reports of a stream."""
    path = new_folder(spark, "stream-stable")
    documents = testdata.stream_table(spark, sf_dir, "documents")
    found = stability_stream(testdata.snapshots_of(documents))
    writer = found.writeStream.format("parquet").option("path", path).outputMode("append")
    _drained(writer, spark, "stability-stream")
    return stability.stability_of_parts(spark.read.schema(stability.PARTS).parquet(path))


PERIOD_SQL = {
    "hour": "strftime(\"timestamp\", '%Y-%m-%d %H:00:00')",
    "day": "strftime(\"timestamp\", '%Y-%m-%d 00:00:00')",
    "week": "strftime(\"timestamp\", '%Y-W%W')",
    "month": "strftime(\"timestamp\", '%Y-%m-01')",
}


@query(
    "stream_trends",
    "results",
    " UNION ALL ".join(
        f"""SELECT '{unit}' AS unit, {key} AS period, count(*) AS count,
          round(avg(execution_time_seconds), 6) AS value FROM results GROUP BY 2"""
        for unit, key in PERIOD_SQL.items()
    ),
)
def stream_trends(spark, sf_dir):
    """All periods of all lengths, from the partial sums of a stream."""
    path = new_folder(spark, "stream-trend")
    arriving = testdata.results_of(testdata.stream_table(spark, sf_dir, "events"))
    _drained(jobs.trend_stream(arriving, path), spark, "trend-stream")
    parts = jobs.trend_parts(spark, path)
    every = []
    for unit in S.PERIODS:
        volume = timeseries.volume_of_parts(parts, unit)
        means = timeseries.trend_of_parts(parts, "execution_time", unit)
        every.append(volume.join(means, "period", "left").select(F.lit(unit).alias("unit"), "period", "count", "value"))
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
