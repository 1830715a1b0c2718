"""Answers and citations from stored page content, and checks of what was extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.functions.scalars import domain_of_url, is_excluded_url, is_web_url, strip

# Texts around and inside an answer on a page.
START_MARKERS = ["1 step completed", "answer images", "images "]
END_MARKERS = ["ask a follow-up", "ask follow-up"]
UI_PHRASES = ["Home Discover", "Spaces Finance", "Upgrade Install", "Answer Images"]
SKIP_PHRASES = [
    "Home",
    "Discover",
    "Spaces",
    "Finance",
    "Install",
    "Upgrade",
    "Account",
    "Ask a follow-up",
    "Thinking...",
]
# Wording of error pages, and how far into an answer it is looked for.
ERROR_PATTERNS = [
    "error|failed|sorry|couldn't|unable to|something went wrong",
    "no results|not found|try again",
]
ERROR_CHECK_CHARS = 10_000
# Bounds of the extraction rules.
MIN_ANSWER_CHARS = 20
MIN_PAGE_CHARS = 200
MIN_CONTAINER_CHARS = 50
MIN_LINK_TEXT = 3
MAX_SOURCES = 20
TIER_THRESHOLD = 3
# Names of the strategies in results.
MARKERS, CLEAN, CONTAINER = "markers", "clean_text", "container"
NO_ANSWER = "No answer text extracted"
ALL_FAILED = "All extraction strategies failed"


def with_marked_answer(pages: DataFrame, name: str = "answer") -> DataFrame:
    """Add the text between the first start marker found and the nearest end marker, else ''.

    Start markers are tried in order; a marker at the very beginning does not count. The
    steps are columns of their own, so a text is folded and searched once per marker.
    """
    text, folded = F.col("full_text"), F.col("_folded")
    # Positions count from 1; start is the first character after the marker.
    found = {f"_start{i}": F.locate(marker, folded) for i, marker in enumerate(START_MARKERS)}
    starts = [
        F.when(F.col(column) > 1, F.col(column) + len(marker))
        for column, marker in zip(found, START_MARKERS)
    ]
    start = F.coalesce(*starts, F.lit(0))
    places = [F.position(F.lit(marker), folded, F.col("_from")) for marker in END_MARKERS]
    end = F.least(F.length(text) + 1, *[F.when(place > 1, place) for place in places])
    body = strip(F.substr(text, F.col("_from"), F.col("_to") - F.col("_from")))
    for phrase in UI_PHRASES:
        body = F.replace(body, F.lit(phrase), F.lit(""))
    inside = (F.col("_from") > 0) & (F.col("_from") < F.col("_to"))
    return (
        pages.withColumn("_folded", F.lower(text))
        .withColumns(found)
        .withColumn("_from", start)
        .withColumn("_to", end)
        .withColumn(name, F.coalesce(F.when(inside, strip(body)), F.lit("")))
        .drop("_folded", "_from", "_to", *found)
    )


def answer_clean_lines(text: Column) -> Column:
    """Non-blank lines without any navigation phrase, '' for short pages."""

    def wanted(line: Column) -> Column:
        keep = line != ""
        for phrase in SKIP_PHRASES:
            keep = keep & ~F.contains(line, F.lit(phrase))
        return keep

    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.array_join(F.filter(lines, wanted), "\n")
    return F.when(F.length(text) > MIN_PAGE_CHARS, kept).otherwise(F.lit(""))


def html_text(html: Column) -> Column:
    """Visible text of an HTML fragment: no scripts, styles or tags, single spaces."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    # The entities of plain text; the ampersand comes last.
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(text, r"\s+", " "))


def answer_container(html: Column) -> Column:
    """Text of the first article element if it is long enough, else ''."""
    inner = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    text = html_text(inner)
    return F.when(F.length(text) > MIN_CONTAINER_CHARS, text).otherwise(F.lit(""))


def extract_answers(pages: DataFrame) -> DataFrame:
    """Try markers, then clean lines, then the article container.

    ``pages`` has ``page_id, full_text`` and optionally ``html``. Adds ``success``,
    ``answer_text``, ``strategy_used`` and ``error``.
    """
    clean = F.coalesce(answer_clean_lines(F.col("full_text")), F.lit(""))
    boxed = answer_container(F.col("html")) if "html" in pages.columns else F.lit("")
    marked = with_marked_answer(pages, "_marked")
    # Later strategies are only computed for pages on which the earlier ones found nothing.
    nothing = (F.col("_marked") == "") & (F.col("_clean") == "")
    tried = marked.withColumn(
        "_clean", F.when(F.col("_marked") == "", clean).otherwise(F.lit(""))
    ).withColumn("_boxed", F.when(nothing, boxed).otherwise(F.lit("")))
    strategy = (
        F.when(F.col("_marked") != "", MARKERS)
        .when(F.col("_clean") != "", CLEAN)
        .when(F.col("_boxed") != "", CONTAINER)
    )
    found = F.coalesce(*[F.nullif(name, F.lit("")) for name in ("_marked", "_clean", "_boxed")])
    return tried.select(
        "page_id",
        found.isNotNull().alias("success"),
        F.coalesce(found, F.lit(NO_ANSWER)).alias("answer_text"),
        strategy.alias("strategy_used"),
        F.when(found.isNull(), ALL_FAILED).alias("error"),
    )


def validation_error(
    answer: Column, links: Column | None = None, check_chars: int | None = None
) -> Column:
    """What is wrong with an extraction, NULL if nothing is.

    In order: too short; error wording; links given but none of them with a web url. With
    ``check_chars`` the wording is looked for in so many characters at the start only, and
    the message says so when the answer is longer.
    """
    head, note = answer, F.lit("")
    if check_chars is not None:
        head = F.substring(answer, 1, check_chars)
        longer = F.length(answer) > check_chars
        note = F.when(longer, F.lit(f" (checked first {check_chars} chars)")).otherwise(note)
    message = F.when(
        F.length(answer) < MIN_ANSWER_CHARS,
        F.concat(F.lit("Answer too short ("), F.length(answer).cast("string"), F.lit(" chars)")),
    )
    for pattern in ERROR_PATTERNS:
        found = F.regexp_extract(head, f"(?i)({pattern})", 1)
        message = message.when(
            found != "",
            F.concat(
                F.lit("Error message detected"),
                note,
                F.lit(": '"),
                found,
                F.lit(f"' matched pattern {pattern}"),
            ),
        )
    if links is not None:
        web = F.exists(links, lambda link: is_web_url(link["url"]))
        message = message.when(
            (F.size(links) > 0) & ~web,
            F.concat(
                F.lit("No valid source URLs found (got "),
                F.size(links).cast("string"),
                F.lit(" sources)"),
            ),
        )
    return message


def harvest_citations(
    candidates: DataFrame,
    excluded: list[str],
    threshold: int = TIER_THRESHOLD,
    cap: int | None = None,
) -> DataFrame:
    """Accepted links of each page, numbered in order.

    ``candidates`` has ``result_id, position, tier, url, text``. A link needs a web url
    that is not excluded and a text of three characters; the first of equal urls counts.
    A further tier is used only while fewer than ``threshold`` links were accepted.

    Equal urls are combined by a partial aggregate. Links are numbered within parts of a
    page by url hash and placed by counts over the parts, so a page with most of the links
    is spread; a ``cap`` keeps the first so many links of a page.
    """
    text = strip(F.col("text"))
    sound = (
        is_web_url(F.col("url"))
        & ~is_excluded_url(F.col("url"), excluded)
        & (F.length(text) >= MIN_LINK_TEXT)
    )
    first = F.min(F.struct("tier", "position", "text")).alias("link")
    links = (
        candidates.filter(sound)
        .select("result_id", "url", "tier", "position", text.alias("text"))
        .groupBy("result_id", "url")
        .agg(first)
        .select("result_id", "url", "link.*")
    )
    # How many links a page has per tier tells which tiers are used.
    per_tier = links.groupBy("result_id").agg(
        F.count_if(F.col("tier") == 1).alias("_first"), F.count_if(F.col("tier") <= 2).alias("_two")
    )
    counted = links.join(per_tier, "result_id")
    used = (
        (F.col("tier") == 1)
        | ((F.col("tier") == 2) & (F.col("_first") < threshold))
        | ((F.col("tier") == 3) & (F.col("_two") < threshold))
    )
    counted = _numbered(counted.filter(used))
    if cap is not None:
        counted = counted.filter(F.col("citation_number") <= cap)
    return counted.select(
        "result_id",
        "url",
        "text",
        domain_of_url(F.col("url")).alias("domain"),
        "citation_number",
        F.col("text").alias("title"),
        F.lit("").alias("snippet"),
    )


def _numbered(links: DataFrame, stretch: int = 10_000) -> DataFrame:
    """Number the links of each page by tier and position.

    A page's positions are cut into stretches; a link is numbered within its stretch, after
    the links of the stretches before it, of which there is one row each. So no task gets
    more links of a page than a stretch holds.
    """
    links = links.withColumn("_part", F.floor(F.col("position") / stretch))
    within = Window.partitionBy("result_id", "tier", "_part").orderBy("position", "url")
    before = Window.partitionBy("result_id").orderBy("tier", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = links.groupBy("result_id", "tier", "_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    placed = links.withColumn("_place", F.row_number().over(within)).join(starts, ["result_id", "tier", "_part"])
    number = (F.col("_start") + F.col("_place")).cast("int")
    return placed.withColumn("citation_number", number).drop("_part", "_place", "_start")


ANCHOR = r"(?is)<a\s[^>]*>.*?</a>"


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of a page: place, target, visible text and raw attributes."""
    anchors = F.regexp_extract_all("html", F.lit(f"({ANCHOR})"), F.lit(1))
    each = pages.select("page_id", F.posexplode(anchors).alias("place", "anchor"))
    attributes = strip(F.regexp_extract("anchor", r"(?is)^<a\s([^>]*)>", 1))
    href = F.regexp_extract(attributes, r"(?i)(?:^|\s)href=[\"']([^\"']*)[\"']", 1)
    return each.select(
        "page_id",
        (F.col("place") + 1).alias("position"),
        href.alias("href"),
        html_text(F.col("anchor")).alias("text"),
        attributes.alias("attributes"),
    ).filter(F.col("href") != "")


def link_list(results: DataFrame) -> DataFrame:
    """Parsed links of each run, one row each, with the number to show.

    The stored citation number is used, else the place in the list.
    """
    each = results.select("id", F.posexplode("sources").alias("place", "link"))
    return each.select(
        "id",
        F.coalesce("link.citation_number", F.col("place") + 1).alias("number"),
        "link.url",
        "link.text",
        "link.domain",
    )
