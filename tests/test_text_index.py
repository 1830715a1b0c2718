from __future__ import annotations

import pytest

from answerlog.operators import lookups, text_index
from answerlog.session import new_folder
from answerlog.sources import results
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def log(spark, make_log):
    path = new_folder(spark, "texts")
    for day in range(1, 9):
        rows = [
            {"query": f"q{day}", "timestamp": f"2024-01-0{day}", "answer_text": f"common words {'Zürich zebra' if day == 3 else 'x'}",
             "sources": f'[{{"url":"https://d{day}.org","text":"t"}}]', "model": "m"},
            {"query": "plain", "timestamp": f"2024-01-0{day}", "answer_text": None if day % 2 else "a\nb ZEBR😀", "model": "n"},
        ]
        results.append_results(spark, make_log(rows).coalesce(1), path)
    assert text_index.index_texts(spark, path) == 8 and text_index.index_texts(spark, path) == 0
    return path


TERMS = ["zürich Z", "ZEBRA", "common", "nowhere", "ab", "", "d5.org", "\nb Z", "R😀", "%_", "q7", "words zürich"]


@pytest.mark.parametrize("term", TERMS)
@pytest.mark.parametrize("search_in,case_sensitive", [("answers", False), ("all", True), ("sources", False), ("queries", False)])
def test_results_equal_the_full_search(spark, log, term, search_in, case_sensitive):
    got = text_index.search_stored(spark, log, term, search_in, case_sensitive)
    want = lookups.search(results.scan_results(spark, log), term, search_in, case_sensitive)
    assert rows_of(got) == rows_of(want)


def test_a_rare_term_skips_files(spark, log):
    assert len(text_index.files_with(spark, log, "zürich zebra")) == 1
    assert text_index.files_with(spark, log, "nowhere") == []
    assert len(text_index.files_with(spark, log, "common")) == 8
    assert text_index.files_with(spark, log, "ab") is None
    found = text_index.search_stored(spark, log, "zürich zebra")
    assert len(found.inputFiles()) < 8 + 2 and found.count() == 1


def test_batches_without_index_are_read(spark, make_log, log):
    path = new_folder(spark, "more")
    results.append_results(spark, make_log([{"query": "one", "timestamp": "2024-01-01"}]), path)
    assert text_index.files_with(spark, path, "one") is None
    text_index.index_texts(spark, path)
    results.append_results(spark, make_log([{"query": "one more", "timestamp": "2024-01-02"}]), path)
    assert text_index.search_stored(spark, path, "one", "queries").count() == 2
    assert text_index.search_stored(spark, path, "more", "queries", limit=1).count() == 1
