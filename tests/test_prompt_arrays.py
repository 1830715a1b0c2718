from __future__ import annotations

import json
import os
import random

import pytest

from answerlog.session import new_folder
from answerlog.sources import prompts

CODES = [
    ("[]", "empty"), (" [ \n ] ", "empty"), ("not json", "invalid_json"), ('{"a": 1}', "not_an_array"), ("[1, 2", "invalid_json"),
    ('[{"a": 1},]', "invalid_json"), ('[{"a": 1} {"b": 2}]', "invalid_json"), ("[1]]", "invalid_json"), ('["x]', "invalid_json"),
    ('[{"a": }]', "invalid_json"), ("[1] [2]", "invalid_json"), ('[{"a": 1}] x', "invalid_json"), ("[,1]", "invalid_json"),
    ('[1]}, {"y":[2]', "invalid_json"), ('[{"a": "x]', "invalid_json"), ("[", "invalid_json"), ('[[{"a": 1}], 2', "invalid_json"),
]


def values(rng):
    texts = ['a"b', "}", "{[", "\\", 'x\\"}', "é😀", "", "]", "},{", '",'] + ["q" * rng.randint(0, 30)]
    kind = rng.random()
    if kind < 0.7:
        return {rng.choice(["query", "model", "}"]): rng.choice([*texts, 5, None, [1, {"deep": "}"}], {}]) for _ in range(rng.randint(0, 3))}
    return rng.choice([1, -2.5, None, True, rng.choice(texts), [], [[{}], "]"], [{"a": texts}]])


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def test_entries_equal_a_plain_parser_in_any_blocks(spark, small_blocks):
    rng, path = random.Random(4), new_folder(spark, "arrays").removeprefix("file://")
    os.makedirs(path)
    want, codes = {}, {}
    for i in range(8):
        array = [values(rng) for _ in range(rng.choice([1, 3, 60]))]
        text = json.dumps(array, ensure_ascii=bool(i % 2), indent=[None, 2][i % 2], separators=None)
        with open(f"{path}/good{i}.json", "w") as file:
            file.write(rng.choice(["", " \n"]) + text + rng.choice(["", "\n\n"]))
        want[f"good{i}.json"], codes[f"good{i}.json"] = array, None
    for i, (text, code) in enumerate(CODES):
        with open(f"{path}/bad{i}.json", "w") as file:
            file.write(text)
        codes[f"bad{i}.json"] = code
    entries, files = prompts.split_prompt_arrays(spark, path)
    assert {os.path.basename(r["file"]): r["error_code"] for r in files.collect()} == codes
    got = {}
    for r in entries.collect():
        got[os.path.basename(r["file"]), r["idx"]] = json.loads(r["raw"])
    assert got == {(name, i): x for name, array in want.items() for i, x in enumerate(array)}


def test_a_large_array_is_read_by_many_tasks(spark, small_blocks):
    path = new_folder(spark, "array").removeprefix("file://")
    os.makedirs(path)
    with open(f"{path}/one.json", "w") as file:
        json.dump([{"query": f"q{i}"} for i in range(300)], file)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20
    entries, _ = prompts.split_prompt_arrays(spark, path)
    checked = prompts.validate_prompts(entries.select("idx", "raw"))
    assert checked.filter("error_code IS NULL").count() == 300
