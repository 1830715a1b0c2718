from __future__ import annotations

import glob
import json
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from answerlog import schema
from answerlog.operators import retention
from answerlog.session import new_folder, open_files, shared_dir
from answerlog.sinks import exports, reports
from answerlog.sources import prompts, results
from tests.conftest import one, rows_of


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(
        [
            {"query": "What is AI?", "model": "gpt/4 x", "timestamp": "2024-06-01 10:00:00", "answer_text": 'Say "hi",\nthere ' + "y" * 600, "sources": '[{"url":"https://a.example/1","text":"A"},{"text":"no url"}]', "execution_time_seconds": 6.55},
            {"query": "What is AI?", "model": None, "timestamp": "2024-06-01 11:00:00", "answer_text": "", "sources": None, "success": False, "error_message": "Timeout"},
            {"query": "Other", "model": "m2", "timestamp": "2025-01-10 09:00:00", "answer_text": "short", "sources": "[]", "execution_time_seconds": 2.25},
        ]
    )


def test_append_goes_on_with_ids(spark, log):
    path = new_folder(spark, "log")
    first = results.append_results(spark, log.drop("id"), path)
    assert sorted(r["id"] for r in first.collect()) == [1, 2, 3]
    batch = spark.createDataFrame([("new", "m")], "query string, model string")
    second = results.append_results(spark, batch, path)
    assert [r["id"] for r in second.collect()] == [4]
    stored = results.scan_results(spark, path)
    assert stored.count() == 4 and stored.columns == schema.RESULTS.names
    assert results.scan_results(spark, path, "2024-06-01", "2024-06-30").count() == 2
    plan = results.scan_results(spark, path, "2024-06-01").select("id")
    assert "PartitionFilters: [isnotnull(dt" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("file_runs, tasks", [(1, 5), (1_000, 1)])
def test_an_appended_batch_keeps_its_texts_where_they_are(spark, make_log, monkeypatch, tmp_path, file_runs, tasks):
    monkeypatch.setattr(results, "FILE_RUNS", file_runs)
    chance = random.Random(5)
    texts = [chance.randbytes(25_000).hex() for _ in range(40)]
    batch = make_log(
        [{"query": f"q{i % 3}", "timestamp": f"2024-06-0{1 + i * 7 % 2} 08:{i * 11 % 40:02d}:00", "answer_text": t} for i, t in enumerate(texts)]
    ).repartition(5, "id")
    path, before = str(tmp_path / "log"), exports.folder_bytes(spark, shared_dir(spark))
    got = rows_of(results.append_results(spark, batch, path))
    assert exports.folder_bytes(spark, shared_dir(spark)) - before < 500_000  # the texts have 2 MB
    assert len(glob.glob(f"{path}/dt=*/batch=*/part-*")) == 2 * tasks
    order = sorted(rows_of(batch), key=lambda r: (r["timestamp"], r["query"]))
    assert {r["id"]: r["answer_text"] for r in got} == {i: r["answer_text"] for i, r in enumerate(order, 1)}
    assert rows_of(results.scan_results(spark, path).orderBy("id")) == sorted(got, key=lambda r: r["id"])


def test_open_files_of_writers_side_by_side(spark):
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(setting), []
    one, two = open_files(spark, 7), open_files(spark, 5)
    for step in (one.__enter__, two.__enter__, lambda: one.__exit__(None, None, None), lambda: two.__exit__(None, None, None)):
        step()
        seen.append(spark.conf.get(setting))
    assert seen == ["7", "7", "5", before]


def test_archive_and_delete(spark, log):
    old, rest = retention.archive_split(log, "2025-01-01")
    assert (old.count(), rest.count()) == (2, 1)
    assert retention.without_failed(log).count() == 2
    assert retention.without_failed(log, "2024-01-01").count() == 3
    assert [r["id"] for r in retention.failed_runs(log, "2025-01-01").collect()] == [2]
    with pytest.raises(ValueError):
        retention.archive_split(log, "last week")
    target, main = new_folder(spark, "old"), new_folder(spark, "main")
    manifest = rows_of(retention.archive(log, "2025-01-01", target, main))
    assert [r["records"] for r in manifest] == [2, 1]
    with pytest.raises(AnalysisException):
        retention.archive(log, "2025-01-01", target)
    back = new_folder(spark, "back")
    assert one(retention.restore_snapshot(spark, target, back))["records"] == 2
    health = one(retention.table_health(spark, back, archive_above=1))
    assert health["records"] == 2 and health["archive_advised"] and health["bytes"] > 0


def test_a_snapshot_is_written_where_its_rows_are(spark, make_log):
    days = [f"2024-06-{1 + i * 7 % 30:02d}" for i in range(60)]
    runs = make_log([{"query": f"q{i}", "timestamp": t, "answer_text": "x" * 100} for i, t in enumerate(days)]).repartition(3)
    path = new_folder(spark, "snapshot")
    assert one(retention.write_snapshot(runs, path))["records"] == 60
    target = new_folder(spark, "target")
    assert one(retention.restore_snapshot(spark, path, target))["records"] == 60
    files = glob.glob(f"{path}/part-*")
    assert len(files) == 3
    for file in files:
        got = [(r["timestamp"], r["id"]) for r in spark.read.parquet(file).collect()]
        assert got == sorted(got)
    for file in files + glob.glob(f"{target}/part-*"):
        assert pq.ParquetFile(file).metadata.row_group(0).column(4).compression == "ZSTD"
    assert spark.read.schema(schema.RESULTS).parquet(target).exceptAll(runs).isEmpty()


def test_a_snapshot_is_packed_more_tightly_than_the_log(spark, make_log):
    chance = random.Random(3)
    words = ["".join(chance.choices("abcdefghiklmnoprstu", k=chance.randint(2, 9))) for _ in range(500)]
    usual_words = [1 / place for place in range(1, 501)]
    runs = make_log([{"timestamp": "2024-06-01", "answer_text": " ".join(chance.choices(words, usual_words, k=400))} for _ in range(600)]).coalesce(1)
    usual, path, target = (new_folder(spark, name) for name in ("usual", "snapshot", "target"))
    runs.write.option("compression", "zstd").parquet(usual)
    retention.write_snapshot(runs, path)
    retention.restore_snapshot(spark, path, target)
    for copy in (path, target):
        assert exports.folder_bytes(spark, copy) < 0.99 * exports.folder_bytes(spark, usual)
        assert spark.read.schema(schema.RESULTS).parquet(copy).exceptAll(runs).isEmpty()


def read_text(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_csv(spark, log):
    path = new_folder(spark, "x") + ".csv"
    summary = one(exports.export_csv(log, path, {"query_pattern": "what"}))
    assert (summary["record_count"], summary["filters_applied"]) == (2, 1)
    assert summary["file_size_bytes"] > 0
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = {r["id"]: r for r in rows_of(back)}
    assert rows["1"]["answer_text"].startswith('Say "hi",\nthere') and rows["1"]["sources"] == "2"
    assert rows["2"]["model"] == "unknown" and rows["2"]["execution_time_seconds"] == "0.0"
    for wrong in ("", path + ".txt"):
        with pytest.raises(ValueError):
            exports.export_csv(log, wrong)
    with pytest.raises(ValueError):
        exports.export_csv(log, path, {"model": "none"})
    report = one(exports.export_csv_report(log, new_folder(spark, "r"), success=True, limit=1))
    assert report["record_count"] == 1


def test_output_checks(tmp_path):
    link = tmp_path / "link.csv"
    link.symlink_to(tmp_path)
    with pytest.raises(ValueError):
        exports.check_output(str(link), ".csv")
    exports.check_output("hdfs://host/x.CSV", ".csv")


def test_json(spark, log):
    path = new_folder(spark, "json")
    assert one(exports.export_json(log, path, query="What is AI?"))["record_count"] == 2
    records = [json.loads(line) for line in read_text(path).splitlines()]
    assert {r["id"]: len(r["sources"]) for r in records} == {1: 2, 2: 0}
    with pytest.raises(ValueError):
        exports.export_json(log, new_folder(spark, "json"), query="nope")
    documents = rows_of(exports.json_documents(results.with_parsed_sources(log)))
    assert len({d["key"] for d in documents}) == 3
    first = next(json.loads(d["document"]) for d in documents if "gpt_4_x" in d["key"])
    assert first["sources"][0]["url"] == "https://a.example/1" and first["error_message"] is None
    with pytest.raises(ValueError):
        exports.json_documents(log.drop("timestamp"))
    assert one(exports.export_json_documents(log, new_folder(spark, "docs")))["record_count"] == 3


def test_markdown(spark, log):
    path = new_folder(spark, "x") + ".md"
    assert one(exports.export_markdown(log, path))["record_count"] == 3
    text = read_text(path)
    assert text.startswith("# Search Results Export\n") and "Total Results: 3" in text
    assert text.index('"Other"') < text.index("**Success**: ✗") < text.index("gpt/4 x")
    assert "1. [A](https://a.example/1)\n2. no url\n" in text
    assert "- **Execution Time**: 6.5s" in text and "- **Execution Time**: 2.2s" in text
    assert "y" * 600 in text, "answers are whole unless a cut is asked for"
    short = new_folder(spark, "x") + ".md"
    exports.export_markdown(log, short, {"success": True}, full=False)
    text = read_text(short)
    assert "y..." in text and "y" * 600 not in text and "Filters Applied: 1" in text
    report = new_folder(spark, "x")
    exports.export_markdown_report(log, report, query_pattern="what")
    text = read_text(report)
    assert "## Result 1\n\n**Query:** What is AI?\n\n**Model:** default" in text
    assert "## Result 2" in text and "- [no url](" not in text.split("## Result 2")[0]
    assert "- [no url](#)" in text


def kept_bytes(spark, *without):
    """Size of what lies in the shared folder, but for some folders of it."""
    files = glob.glob(f"{shared_dir(spark)}/**/*", recursive=True)
    return sum(os.path.getsize(f) for f in files if os.path.isfile(f) and not f.startswith(without))


def test_a_report_keeps_no_copy_of_the_answers(spark, make_log):
    base = {"timestamp": "2024-06-01 10:00:00", "model": "m"}
    runs = make_log([{**base, "query": f"q{i}", "answer_text": f"{i} " * 5000} for i in range(40)])
    path, before = new_folder(spark, "report"), kept_bytes(spark)
    assert one(exports.export_markdown_report(runs, path))["record_count"] == 40
    assert kept_bytes(spark, path) - before < 100_000
    text = read_text(path)
    assert [text.index(f"## Result {40 - i}\n\n**Query:** q{i}\n") for i in range(40)]


def test_display(log):
    shown = {r["id"]: r["t"] for r in rows_of(results.with_parsed_sources(log).select("id", reports.display_text().alias("t")))}
    assert "Error: Timeout" in shown[2] and "Model: default" in shown[2]
    assert "1. A [a.example]\n   https://a.example/1\n" in shown[1]
    assert "2. no url\n   N/A\n" in shown[1] and "Execution Time: 6.55s" in shown[1]


def test_reports(spark, log):
    pieces = rows_of(reports.comparison_report(log, "What is AI?"))
    text = "\n".join(p["line"] for p in pieces)
    assert "Models Compared: 2" in text and "| gpt/4 x | 1 | 6.5s | 100% |" in text
    assert text.index("### gpt/4 x") < text.index("### unknown") and "#### Result 1" in text
    assert rows_of(reports.comparison_report(log, "nope")) == []
    summary = "\n".join(p["line"] for p in rows_of(reports.summary_report(log)))
    assert "- **Total Results**: 3" in summary and "- **Successful Results**: 2/3" in summary
    assert "| m2 | 1 | 100% | 2.2s |" in summary and "| What is AI? | 2 |" in summary
    path = new_folder(spark, "s") + ".md"
    assert one(exports.export_report(reports.summary_report(log), path))["record_count"] > 20
    with pytest.raises(ValueError):
        exports.export_report(reports.comparison_report(log, "nope"), path + ".md")
    table = rows_of(reports.markdown_table(log.select("id", "model"), {"id": "Id", "model": "M"}, ["id"]))
    assert [r["line"] for r in table][1:4] == ["| --- | --- |", "| 1 | gpt/4 x |", "| 2 |  |"]
    assert rows_of(reports.markdown_table(log.limit(0).select("id"), {"id": "Id"}, ["id"])) == []


@pytest.mark.parametrize("format", exports.FORMATS)
def test_group_exports(spark, log, format):
    path = new_folder(spark, "groups")
    grouped = exports.label_groups(log, "model")
    got = {r["group_key"]: r for r in rows_of(exports.export_groups(grouped, path, format))}
    assert {k: r["record_count"] for k, r in got.items()} == {"gpt/4 x": 1, "default": 1, "m2": 1}
    assert all(r["files"] >= 1 and r["bytes"] > 0 for r in got.values())


@pytest.mark.parametrize("format", exports.FORMATS)
def test_groups_of_a_large_log_are_written_where_their_rows_are(spark, make_log, monkeypatch, format):
    runs = make_log([{"query": f"q{i}", "model": f"m{i % 3}", "timestamp": "2024-01-01", "answer_text": f"a\n{i}"} for i in range(90)])
    grouped = exports.label_groups(runs.repartition(4))
    gathered, placed = new_folder(spark, "gathered"), new_folder(spark, "placed")
    counts = [tuple(r) for r in exports.export_groups(grouped, gathered, format).select("group_key", "record_count").collect()]
    monkeypatch.setattr(exports, "FILE_RUNS", 1)
    got = rows_of(exports.export_groups(grouped, placed, format))
    assert [(r["group_key"], r["record_count"]) for r in got] == counts == [(f"m{i}", 30) for i in range(3)]
    assert all(r["files"] > 1 for r in got), "more than one task has rows of a group"
    there = exports.read_groups(spark, placed, format)
    assert there.exceptAll(exports.read_groups(spark, gathered, format)).isEmpty()
    assert all(f.endswith(".gz") for f in glob.glob(f"{placed}/*/part-*"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    with pytest.raises(ValueError):
        exports.export_groups(grouped.limit(0), new_folder(spark, "none"), format)


def test_blocks_are_told_apart_whatever_the_answers_hold(spark, make_log):
    texts = ["a\n\n---\n\nb", f"x {exports.BLOCK_END} y", "<!-- end of \\\\block -->", "---\n", "", None]
    runs = make_log([{"query": f"q{i}", "model": "m", "timestamp": "2024-01-01", "answer_text": t} for i, t in enumerate(texts)])
    path = new_folder(spark, "rules")
    written = one(exports.export_groups(exports.label_groups(runs), path, "md"))
    assert written["record_count"] == len(texts)
    blocks = {r["value"] for r in exports.read_groups(spark, path, "md").collect()}
    parsed = results.with_parsed_sources(runs)
    assert blocks == {r[0] for r in parsed.select(reports.markdown_block()).collect()}


def test_groupings(log):
    assert {r["group_key"] for r in rows_of(exports.model_groups(log))} == {"gpt_4_x", "m2"}
    weeks = {r["group_key"] for r in rows_of(exports.period_groups(log, "week"))}
    assert weeks == {"2024-W22", "2025-W02"}
    assert {r["group_key"] for r in rows_of(exports.label_groups(log, "date"))} == {"2024-06-01", "2025-01-10"}
    for call in (
        lambda: exports.period_groups(log, "hour"),
        lambda: exports.label_groups(log, "query"),
        lambda: exports.export_groups(log, "x", "xml"),
    ):
        with pytest.raises(ValueError):
            call()


# -- prompts ---------------------------------------------------------------------------


def test_prompt_rules(spark):
    raw = {
        '{"query": "  What is it? \\n", "model": " sonar ", "no_screenshot": true}': None,
        '{"query": "inner   space", "extra": [1]}': None,
        '{"query": "x", "model": "gpt-5.1"}': None,
        "[1]": "not_an_object",
        '"text"': "not_an_object",
        "{broken": "invalid_json",
        "{}": "query_missing",
        '{"query": null}': "query_not_string",
        '{"query": 5}': "query_not_string",
        '{"query": " \\t "}': "query_empty",
        '{"query": "x", "model": 7}': "model_not_string",
        '{"query": "x", "model": null}': "model_not_string",
        '{"query": "x", "model": "GPT-5.1"}': "model_unknown",
        '{"query": "x", "no_screenshot": 1}': "no_screenshot_not_boolean",
        '{"query": "x", "no_screenshot": null}': "no_screenshot_not_boolean",
        '{"query": "", "model": 7}': "query_empty",
    }
    df = spark.createDataFrame(list(enumerate(raw)), "idx long, raw string")
    checked = prompts.validate_prompts(df)
    got = {r["raw"]: r for r in rows_of(checked)}
    assert {k: r["error_code"] for k, r in got.items()} == raw
    first = got[next(iter(raw))]
    assert (first["query"], first["model"], first["no_screenshot"]) == ("What is it?", "sonar", True)
    valid, rejected = prompts.split_prompts(checked)
    assert valid.count() == 3 and rejected.count() == 13
    filled = rows_of(prompts.apply_defaults(valid, "grok-4", limit=2).orderBy("idx"))
    assert [(r["query"], r["model"], r["no_screenshot"]) for r in filled] == [
        ("What is it?", "sonar", True),
        ("inner   space", "grok-4", False),
    ]


def test_prompt_files(spark, tmp_path):
    texts = {
        "good.json": '[{"query": "a"}, {"query": "b"}, 3]',
        "bad.json": '[{"query": "a"',
        "object.json": '{"query": "a"}',
        "empty.json": "[]",
        "many.json": json.dumps([{"query": str(i)} for i in range(6)]),
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    files = prompts.read_prompt_files(spark, str(tmp_path), max_prompts=5)
    codes = {os.path.basename(r["file"]): r["error_code"] for r in files.select("file", "error_code").collect()}
    assert codes == {
        "good.json": None,
        "bad.json": "invalid_json",
        "object.json": "not_an_array",
        "empty.json": "empty",
        "many.json": "too_many",
    }
    entries = prompts.validate_prompts(prompts.prompts_of_files(files))
    got = [(r["idx"], r["query"], r["error_code"]) for r in rows_of(entries.orderBy("idx"))]
    assert got == [(0, "a", None), (1, "b", None), (2, None, "not_an_object")]


def test_prompt_lines_keep_their_order(spark, tmp_path):
    lines = [json.dumps({"query": f"q{i}"}) for i in range(50)]
    (tmp_path / "p.jsonl").write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    got = prompts.read_prompt_lines(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["idx"], r["raw"]) for r in got] == list(enumerate(lines))
