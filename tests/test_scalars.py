from __future__ import annotations

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from answerlog.functions import scalars as S
from answerlog.operators.aliases import resolve_model
from answerlog.operators.similarity import sequence_ratio_of
from tests.conftest import rows_of


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_lengths_count_code_points(spark):
    values = ["", "abc", "日本語", "😀 ok", None]
    assert apply(spark, S.answer_length, values) == [0, 3, 3, 4, None]


def test_source_count_and_parsing(spark):
    values = [
        '[{"url":"u","text":"t"},{"url":null}]',
        "[]",
        "",
        None,
        "not json",
        '{"url":"u"}',
        '[1,{"url":"v","extra":{"a":1}}]',
    ]
    assert apply(spark, S.source_count, values) == [2, 0, 0, 0, 0, 0, 2]
    urls = apply(spark, lambda c: F.transform(S.parse_sources(c), lambda x: x["url"]), values)
    assert urls == [["u", None], [], [], [], [], [], ["v"]]


@pytest.mark.parametrize(
    "text, day_week, iso_week",
    [
        ("2024-12-30 10:00:00", "2024-W53", "2024-W01"),
        ("2023-01-01 00:00:00", "2023-W00", "2023-W52"),
        ("2023-01-02 23:59:59", "2023-W01", "2023-W01"),
        ("2021-01-03 00:00:00", "2021-W00", "2021-W53"),
        ("2020-02-29 12:30:15", "2020-W08", "2020-W09"),
    ],
)
def test_weeks_at_year_ends(spark, text, day_week, iso_week):
    when = datetime.datetime.fromisoformat(text)
    values = [when]
    assert when.strftime("%Y-W%W") == day_week and when.strftime("%Y-W%V") == iso_week
    for style, want in [("start", day_week), ("short", day_week), ("iso", iso_week)]:
        got = apply(spark, lambda c: S.period_key(c, "week", style), values, "timestamp_ntz")
        assert got == [want]


def test_period_labels(spark):
    value = [datetime.datetime(2024, 3, 5, 7, 8, 9, 120000)]
    want = {
        ("hour", "start"): "2024-03-05 07:00:00",
        ("day", "start"): "2024-03-05 00:00:00",
        ("month", "start"): "2024-03-01",
        ("hour", "short"): "2024-03-05 07:00",
        ("day", "short"): "2024-03-05",
        ("month", "short"): "2024-03",
        ("day", "iso"): "2024-03-05",
        ("month", "iso"): "2024-03",
    }
    for (period, style), label in want.items():
        got = apply(spark, lambda c: S.period_key(c, period, style), value, "timestamp_ntz")
        assert got == [label]
    missing = apply(spark, lambda c: S.period_key(c, "day", "iso"), [None], "timestamp_ntz")
    assert missing == ["unknown"]
    with pytest.raises(ValueError):
        S.period_key(F.col("v"), "year")


def test_domains(spark):
    values = [
        "https://www.example.com/path",
        "https://example.com:8080/path",
        "not a url",
        "",
        "http://a.b.c?x=1",
        None,
    ]
    assert apply(spark, S.domain_of_url, values) == [
        "example.com",
        "example.com:8080",
        "",
        "",
        "a.b.c",
        "",
    ]
    kept = apply(spark, lambda c: S.domain_for_display(F.lit(""), c), values[:1])
    assert kept == ["www.example.com"]


def test_excluded_urls(spark):
    values = ["https://a.example/LOGIN?x", "https://a.example/b", "https://Ask.Example/x"]
    parts = ["ask.example", *S.EXCLUDED_URL_PARTS]
    assert apply(spark, lambda c: S.is_excluded_url(c, parts), values) == [True, False, True]


def test_truncation(spark):
    values = [None, "", "abc", "abcde", "ab \n cdef"]
    assert apply(spark, lambda c: S.truncate_text(c, 4), values) == ["", "", "abc", "abcd...", "ab..."]
    assert apply(spark, lambda c: S.answer_preview(c, 4), values)[-1] == "ab \n..."


def test_time_texts(spark):
    values = [
        "2025-01-11T14:30:00Z",
        "2025-01-11T14:30:00.123456+05:30",
        "2025-01-11 14:30:00",
        "2025-01-11",
        "yesterday",
        "2025-13-40",
        None,
    ]
    shown = apply(spark, S.format_time, values)
    assert shown[:3] == ["2025-01-11 14:30:00"] * 3
    assert shown[3:] == ["2025-01-11 00:00:00", "yesterday", "2025-13-40", None]
    assert apply(spark, lambda c: S.format_time(c, "N/A"), [None]) == ["N/A"]


def test_markdown_characters(spark):
    value = "\\*_`[]()#+-.! plain"
    want = "".join("\\" + c if c in S.MARKDOWN_SPECIAL else c for c in value)
    assert apply(spark, S.escape_markdown, [value]) == [want]


def test_decimals_round_like_exact_binary_values(spark):
    rnd = random.Random(1)
    values = [0.05, 0.15, 0.25, 0.35, 6.55, 12.25, 0.0, 99.95, -1.25, 1234567.85, 0.999]
    values += [round(rnd.uniform(0, 500), 2) for _ in range(300)]
    for digits in (1, 2):
        got = apply(spark, lambda c: S.fixed_decimals(c, digits), values, "double")
        assert got == [f"{v:.{digits}f}" for v in values]


def test_byte_sizes(spark):
    values = [0, 1023, 1024, 1280, 1536, 1024**2, 5 * 1024**3 + 7, 3 * 1024**4, 2000 * 1024**4]
    want = ["0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1.5 KB", "1.0 MB", "5.0 GB", "3.0 TB", "2000.0 TB"]
    assert apply(spark, S.format_bytes, values, "long") == want


def test_export_keys(spark):
    when = F.lit("2025-01-11 14:30:00").cast("timestamp_ntz")
    key = apply(spark, lambda c: S.export_key(F.lit("What is RAM?"), when, c), ["GPT-4 x", "", None])
    assert key[0].startswith("result_20250111_143000_") and key[0].endswith("_gpt_4_x.json")
    assert key[1] == key[2] == key[0].replace("_gpt_4_x", "")


def test_positional_similarity(spark):
    pairs = [("", ""), ("", "a"), ("abc", "abd"), ("abc", "abcdef"), ("é😀x", "é😀y"), ("a", "b")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.orderBy("i").select(S.positional_similarity(F.col("a"), F.col("b"))).collect()
    assert [round(row[0], 6) for row in got] == [1.0, 0.0, 0.666667, 0.5, 0.666667, 0.0]


def test_sequence_ratio_is_difflib(spark):
    rnd = random.Random(2)
    pairs = [
        ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30))),) * 1
        + ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30))),)
        for _ in range(200)
    ]
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in rows_of(df.withColumn("r", sequence_ratio_of()("a", "b"))):
        want = difflib.SequenceMatcher(None, row["a"], row["b"]).ratio()
        assert row["r"] == pytest.approx(want)


def test_model_aliases(spark):
    labels = ["GPT-5.1", "gpt 5", " Sonnet 4.5 ", "Claude Sonnet 4.5 Thinking", "Grok", "none", "", None]
    got = apply(spark, resolve_model, labels)
    assert got == [
        "gpt-5.1",
        "gpt-5",
        "claude-sonnet-4.5",
        "claude-sonnet-4.5",
        "grok-4",
        None,
        None,
        None,
    ]
