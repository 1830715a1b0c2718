"""Registry of the queries over the test tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlog.functions.scalars import parse_sources, show_time, source_count
from answerlog.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The derived tables of answerlog.sources.testdata, written for DuckDB.
VIEWS = {
    "results": """
        SELECT e.event_id AS id,
          e.event_type || ' topic ' || json_extract_string(e.props, '$.k') AS query,
          CASE WHEN e.user_id % 6 = 5 THEN NULL
               ELSE 'model-' || CAST(e.user_id % 6 AS VARCHAR) END AS model,
          e.ts AS "timestamp",
          CASE WHEN e.event_id % 23 = 0 THEN NULL WHEN e.event_id % 23 = 1 THEN ''
               ELSE d.text END AS answer_text,
          CASE e.event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'not json' WHEN 2 THEN '[]'
               ELSE '[' || repeat('{"url":"https://ex.org/a","text":"s"},',
                                  CAST(e.event_id % 4 AS INT))
                        || '{"url":"https://ex.org/b","text":"t"}]' END AS sources,
          CAST(NULL AS VARCHAR) AS screenshot_path,
          CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE e.value END AS execution_time_seconds,
          e.event_id % 7 <> 3 AS success,
          CASE WHEN e.event_id % 7 = 3 THEN 'Timeout' END AS error_message
        FROM events e
        LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "counted": """
        SELECT *, CASE WHEN json_valid(sources) THEN CAST(json_array_length(sources) AS BIGINT)
                       ELSE 0 END AS n_known,
          CASE WHEN sources IS NULL OR NOT json_valid(sources) THEN 0
               ELSE CAST(json_array_length(sources) AS BIGINT) END AS source_count,
          CASE WHEN json_valid(sources) THEN CAST(json_array_length(sources) AS BIGINT)
               END AS array_length
        FROM results""",
    "citations": """
        SELECT e.event_id AS result_id, g.i AS position, 1 + g.i % 3 AS tier, p.url,
          CASE WHEN g.i % 4 = 0 THEN 'AB' ELSE 'Source ' || CAST(g.i AS VARCHAR) END AS text
        FROM events e CROSS JOIN range(1, 7) g(i)
        JOIN pages p ON p.page_id =
          (e.event_id * 7 + (g.i * g.i) % 5) % (SELECT count(*) FROM pages)
        WHERE g.i <= e.event_id % 7""",
    "page_text": """
        SELECT doc_id AS page_id, CASE doc_id % 4
          WHEN 0 THEN 'nav 1 step completed ' || text || ' Home Discover Ask a follow-up tail'
          WHEN 1 THEN 'Home' || chr(10) || text || chr(10) || chr(10) || 'Account menu'
          WHEN 2 THEN 'x images Sorry, something went wrong ' || text || ' ask follow-up'
          ELSE text END AS full_text
        FROM documents""",
    "snapshots": """
        SELECT d.doc_id AS entity_id, g.i AS seq,
          substring(d.text, 1, CAST(ceil(length(d.text) * least(g.i, 2 + d.doc_id % 8)
                                         / (2 + d.doc_id % 8)) AS INT)) AS text
        FROM documents d CROSS JOIN range(1, 11) g(i)""",
    "prompts": """
        SELECT event_id AS idx, CASE WHEN event_id % 9 = 8 THEN '[1]' ELSE CASE event_id % 8
          WHEN 0 THEN '{"query":"  padded  "}'
          WHEN 1 THEN '{"model":"sonar"}'
          WHEN 2 THEN '{"query":5}'
          WHEN 3 THEN '{"query":"   "}'
          WHEN 4 THEN '{"query":"q","model":7}'
          WHEN 5 THEN '{"query":"q","model":" sonar "}'
          WHEN 6 THEN '{"query":"q","model":"nope"}'
          ELSE '{"query":"q","no_screenshot":1}' END END AS raw
        FROM events""",
    "observations": """
        SELECT user_id AS entity, event_type AS selector, CAST(event_id AS DOUBLE) AS elapsed,
          event_id % 3 = 0 AS found, CAST(event_id % 10 AS INT) AS cnt
        FROM events""",
}
NEEDS = {"counted": ["results"]}
ROW_COLUMNS = """id, query, model, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
  md5(answer_text) AS answer_md5, CASE WHEN json_valid(sources) THEN array_to_string(
    list_transform(from_json(sources, '[{"url":"VARCHAR","text":"VARCHAR"}]'),
      lambda x: x.url || ' ' || x.text), '|') ELSE '' END AS links,
  source_count, screenshot_path, execution_time_seconds, success, error_message"""


def sql_over(views: str, body: str) -> str:
    """A statement over the named derived tables; a leading comma adds more of them."""
    names: list[str] = []
    for name in views.split():
        names += [need for need in NEEDS.get(name, []) if need not in names]
        names += [name] if name not in names else []
    heads = ", ".join(f"{name} AS ({VIEWS[name]})" for name in names)
    return f"WITH {heads} {body}" if names else body


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query and, if there is one, the SQL with the same result."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(function(ship_package(spark), sf_dir))
        if sql is not None:
            SQL[name] = sql_over(views, sql)
        return function

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Floating-point results to six decimals, as sums depend on the order of rows."""
    return df.select(
        *[
            F.round(field.name, 6).alias(field.name)
            if isinstance(field.dataType, T.DoubleType)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )


def shown(results: DataFrame) -> DataFrame:
    """A whole run as the registered lookups return it: every column, the answer by its hash
    and the links as they are parsed."""
    links = F.transform(parse_sources(F.col("sources")), lambda x: F.concat_ws(" ", x["url"], x["text"]))
    return results.select(
        "id",
        "query",
        "model",
        show_time(F.col("timestamp")).alias("timestamp"),
        F.md5("answer_text").alias("answer_md5"),
        F.array_join(links, "|").alias("links"),
        source_count(F.col("sources")).alias("source_count"),
        "screenshot_path",
        "execution_time_seconds",
        "success",
        "error_message",
    )
