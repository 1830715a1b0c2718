from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from answerlog import schema
from answerlog.functions.scalars import EXCLUDED_URL_PARTS
from answerlog.operators import extract, stability
from tests.conftest import one, rows_of


def answers(spark, texts, html=None):
    rows = [(i, t, (html or {}).get(i)) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id int, full_text string, html string")
    return {r["page_id"]: r for r in rows_of(extract.extract_answers(pages))}


def test_markers(spark):
    got = answers(
        spark,
        [
            "nav 1 step completed \n The answer. Ask a follow-up",
            "x Images first 1 step completed second ask follow-up later ask a follow-up",
            "images at the start do not count ask follow-up",
            "menu answer images Home Discover The body Answer Images text",
            "no marker " * 3,
            None,
        ],
    )
    assert got[0]["answer_text"] == "The answer." and got[0]["strategy_used"] == extract.MARKERS
    assert got[1]["answer_text"] == "second"
    assert got[2]["success"] is False and got[2]["error"] == extract.ALL_FAILED
    assert got[3]["answer_text"] == "The body  text"
    assert not got[4]["success"] and not got[5]["success"]
    assert got[5]["answer_text"] == extract.NO_ANSWER


def test_clean_lines_and_container(spark):
    long_text = "Home\n  first line \n\n" + "body " * 60 + "\nAccount menu\nlast"
    box = "<main><ARTICLE class='a'><script>x()</script><p>" + "word &amp; " * 20 + "</p></article></main>"
    got = answers(
        spark,
        [long_text, "short", "Home\n" * 60, "short"],
        {1: box, 2: "<article>tiny</article>"},
    )
    assert got[0]["answer_text"] == "first line\n" + ("body " * 60).strip() + "\nlast"
    assert got[0]["strategy_used"] == extract.CLEAN
    assert got[1]["answer_text"] == ("word & " * 20).strip()
    assert got[1]["strategy_used"] == extract.CONTAINER
    assert not got[2]["success"] and not got[3]["success"]


def test_validation(spark):
    data = [
        ("short", None),
        ("I'm SORRY, I could not do that for you", None),
        ("This page was Not Found on the server", None),
        ("A perfectly fine answer to the prompt", []),
        ("A perfectly fine answer to the prompt", [("ftp://a", "t"), (None, "t")]),
        ("A perfectly fine answer to the prompt", [("ftp://a", "t"), ("https://b", "t")]),
        ("x" * 10_001 + " error", None),
        ("an error " + "x" * 10_001, None),
    ]
    df = spark.createDataFrame(data, "answer string, links array<struct<url string, text string>>")
    message = extract.validation_error(F.col("answer"), F.col("links")).alias("m")
    got = [r["m"] for r in rows_of(df.select(message))]
    assert got[0] == "Answer too short (5 chars)"
    assert got[1] == f"Error message detected: 'SORRY' matched pattern {extract.ERROR_PATTERNS[0]}"
    assert got[2].startswith("Error message detected: 'Not Found' matched")
    assert got[3] is None
    assert got[4] == "No valid source URLs found (got 2 sources)"
    assert got[5] is None
    assert got[6].startswith("Error message detected: 'error'"), "errors are found after 10,000 characters"
    assert got[7].startswith("Error message detected: 'error'")
    bounded = extract.validation_error(F.col("answer"), F.col("links"), check_chars=10_000).alias("m")
    got = [r["m"] for r in rows_of(df.select(bounded))]
    assert got[6] is None
    assert got[7].startswith("Error message detected (checked first 10000 chars): 'error'")


def harvest_by_loop(links, excluded, threshold, cap):
    accepted, seen, counts = [], set(), 0
    for tier in (1, 2, 3):
        if tier > 1 and len(accepted) >= threshold:
            break
        for link in sorted((x for x in links if x["tier"] == tier), key=lambda x: x["position"]):
            url, text = link["url"], (link["text"] or "").strip()
            if len(accepted) >= cap or not url or not url.startswith(("http://", "https://")):
                continue
            if any(part in url.lower() for part in excluded) or url in seen or len(text) < 3:
                continue
            counts += 1
            accepted.append((url, text, counts))
            seen.add(url)
    return accepted


@pytest.mark.parametrize("threshold, cap", [(3, 20), (2, 3), (5, 4), (1, 1)])
def test_harvest_equals_the_loop(spark, threshold, cap):
    rnd = random.Random(threshold * 100 + cap)
    links = []
    for page in range(40):
        for position in range(rnd.randint(0, 14)):
            url = rnd.choice(["https://a.example/%d", "http://www.b.example/%d", "/rel/%d", "https://c.example/login%d"])
            links.append(
                {
                    "result_id": page,
                    "position": position,
                    "tier": rnd.randint(1, 3),
                    "url": None if rnd.random() < 0.1 else url % rnd.randint(0, 6),
                    "text": rnd.choice(["ok text", " ab ", "  abc ", None, "title"]),
                }
            )
    df = spark.createDataFrame(links, "result_id int, position int, tier int, url string, text string")
    got = {}
    found = extract.harvest_citations(df, EXCLUDED_URL_PARTS, threshold, cap)
    for row in rows_of(found):
        got.setdefault(row["result_id"], []).append((row["url"], row["text"], row["citation_number"]))
        assert row["domain"] in ("a.example", "b.example") and row["title"] == row["text"]
    for page in range(40):
        mine = [x for x in links if x["result_id"] == page]
        want = harvest_by_loop(mine, EXCLUDED_URL_PARTS, threshold, cap)
        assert sorted(got.get(page, []), key=lambda x: x[2]) == want


def test_one_page_with_most_links(spark):
    links = spark.range(20_000).select(
        F.lit(1).alias("result_id"),
        F.col("id").cast("int").alias("position"),
        (F.col("id") % 2 + 1).cast("int").alias("tier"),
        F.concat(F.lit("https://x.example/"), (F.col("id") % 700).cast("string")).alias("url"),
        F.lit("text").alias("text"),
    )
    got = rows_of(extract.harvest_citations(links, []).orderBy("citation_number"))
    assert [r["citation_number"] for r in got] == list(range(1, 351)), "tier 1 suffices, and all of it counts"
    few = rows_of(extract.harvest_citations(links, [], cap=20).orderBy("citation_number"))
    assert few == got[:20]
    more = rows_of(extract.harvest_citations(links, [], threshold=351).orderBy("citation_number"))
    assert [r["citation_number"] for r in more] == list(range(1, 701)) and more[:350] == got
    split = rows_of(extract._numbered(links.dropDuplicates(["url"]), stretch=7))
    order = sorted(split, key=lambda r: (r["tier"], r["position"]))
    assert [r["citation_number"] for r in order] == list(range(1, 701))
    assert got[0]["url"] == "https://x.example/0" and got[1]["url"] == "https://x.example/2"


def test_page_links(spark):
    html = (
        '<a href="/x">One</a><A class="c" HREF=\'https://y.example\'><b>Two</b>\n words</A>'
        "<a name='n'>none</a><abbr>no</abbr>"
    )
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = rows_of(extract.page_links(pages).orderBy("position"))
    assert [(r["position"], r["href"], r["text"]) for r in got] == [
        (1, "/x", "One"),
        (2, "https://y.example", "Two words"),
    ]


def test_link_numbers(spark, make_log):
    from answerlog.sources.results import with_parsed_sources

    raw = '[{"url":"u","citation_number":7},{"url":"v"}]'
    rows = rows_of(extract.link_list(with_parsed_sources(make_log([{"sources": raw}]))))
    assert [r["number"] for r in rows] == [7, 2]


# -- stability -------------------------------------------------------------------------


def stable_by_loop(texts, threshold, min_chars):
    count, last = 0, ("", 0)
    for seq, text in enumerate(texts, 1):
        now = (hashlib.md5(text.encode()).hexdigest() if text else "", len(text))
        if len(text) >= min_chars:
            if now == last:
                count += 1
                if count >= threshold:
                    return seq
                continue
        count = 0
        last = now
    return None


def growing_texts(seed):
    rnd = random.Random(seed)
    entities = {}
    for entity in range(60):
        texts, text = [], ""
        for _ in range(rnd.randint(1, 40)):
            if rnd.random() < 0.45:
                text += "word " * rnd.randint(0, 3)
            elif rnd.random() < 0.05:
                text = ""
            texts.append(text)
        entities[entity] = texts
    return entities


@pytest.mark.parametrize("threshold, min_chars", [(3, 50), (3, 20), (2, 0), (1, 10)])
def test_stability_equals_the_loop(spark, threshold, min_chars):
    entities = growing_texts(7)
    rows = [(e, s, t) for e, texts in entities.items() for s, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, "entity_id int, seq long, text string")
    got = {r["entity_id"]: r for r in rows_of(stability.content_stability(df, threshold, min_chars))}
    for entity, texts in entities.items():
        want = stable_by_loop(texts, threshold, min_chars)
        assert got[entity]["stable_seq"] == want and got[entity]["checks"] == len(texts)
        assert got[entity]["stable"] == (want is not None)


@pytest.mark.parametrize("threshold, min_chars", [(3, 20), (2, 0), (1, 10), (4, 5)])
def test_stability_with_gaps_in_the_numbers(spark, threshold, min_chars):
    """Checks before a chunk may come from any number of chunks."""
    entities, rnd = growing_texts(11), random.Random(3)
    rows, numbers = [], {}
    for entity, texts in entities.items():
        places = sorted(rnd.sample(range(1, 12 * len(texts) + 1), len(texts)))
        numbers[entity] = places
        rows += [(entity, s, t) for s, t in zip(places, texts)]
    df = spark.createDataFrame(rows, "entity_id int, seq long, text string")
    got = {r["entity_id"]: r for r in rows_of(stability.content_stability(df, threshold, min_chars))}
    for entity, texts in entities.items():
        want = stable_by_loop(texts, threshold, min_chars)
        assert got[entity]["stable_seq"] == (want and numbers[entity][want - 1])


def test_schema_defaults(spark):
    batch = spark.createDataFrame([("q", [("u", "t")])], "query string, sources array<struct<url string, text string>>")
    row = one(schema.conform(batch))
    assert row["success"] is True and row["timestamp"] is not None
    assert row["sources"] == '[{"url":"u","text":"t"}]' and row["model"] is None
