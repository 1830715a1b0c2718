"""Scalar column functions. Everything here is a built-in Spark expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlog import schema

# Characters that Markdown gives a meaning.
MARKDOWN_SPECIAL = "\\*_`[]()#+-.!"
# White space of the Unicode standard, as far as text functions strip it.
WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
# How many characters a report shows of an answer.
PREVIEW_CHARS = 500
COMPARISON_CHARS = 300
# Url parts that mark a link as part of the answer service itself.
# The host of the service that was asked belongs in front of these; callers add it.
EXCLUDED_URL_PARTS = [
    "/login",
    "/upgrade",
    "/settings",
    "/pricing",
    "/search",
    "/spaces",
    "/home",
    "/discover",
]


def strip(text: Column) -> Column:
    """Remove white space, line ends included, at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def answer_length(answer: Column) -> Column:
    """Length in code points; NULL stays NULL."""
    return F.length(answer).cast("long")


def json_array_length(raw: Column) -> Column:
    """Length of a JSON array; NULL for NULL, malformed text or another JSON type."""
    return F.json_array_length(raw).cast("long")


def source_count(raw: Column) -> Column:
    """Number of links in the raw JSON text; anything but an array counts 0."""
    return F.coalesce(json_array_length(raw), F.lit(0).cast("long"))


def parse_sources(raw: Column) -> Column:
    """Array of link records; NULL, '' and malformed text give an empty array.

    Entries that are no objects are left out, as no link can be read from them.
    """
    items = F.from_json(F.when(json_array_length(raw).isNotNull(), raw), "array<string>")
    links = F.transform(
        F.filter(items, lambda item: F.ltrim(item).startswith("{")),
        lambda item: F.from_json(item, schema.SOURCE),
    )
    return F.coalesce(links, F.array().cast(f"array<{schema.SOURCE.simpleString()}>"))


def model_label(model: Column, label: str) -> Column:
    """Show a missing or empty model under ``label``."""
    return F.coalesce(F.nullif(model, F.lit("")), F.lit(label))


def success_number(success: Column) -> Column:
    """1.0 for success, 0.0 otherwise; an unknown outcome is not a success."""
    return F.coalesce(success, F.lit(False)).cast("double")


# -- time ------------------------------------------------------------------------------

PERIODS = ("hour", "day", "week", "month")


def check_period(period: str) -> None:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, got {period!r}")


def _monday_week(timestamp: Column) -> Column:
    """Two-digit number of the week, weeks from Monday, 00 before the first Monday."""
    day = timestamp.cast("date")
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.lpad(week.cast("string"), 2, "0")


def _iso_text(timestamp: Column, chars: int) -> Column:
    return F.substring(timestamp.cast("string"), 1, chars)


def period_key(timestamp: Column, period: str, style: str = "start") -> Column:
    """Label of the period a time falls in.

    ``start``: the first moment of the period (weeks: ``YYYY-Www``);
    ``short``: the label cut to the period; ``iso``: day, month, or calendar year with the
    ISO week number, and ``unknown`` where there is no time.
    """
    check_period(period)
    if style not in ("start", "short", "iso"):
        raise ValueError(f"unknown label style {style!r}")
    if period == "week":
        year = _iso_text(timestamp, 4)
        if style == "iso":
            number = F.lpad(F.weekofyear(timestamp.cast("date")).cast("string"), 2, "0")
            key = F.concat(year, F.lit("-W"), number)
        else:
            key = F.concat(year, F.lit("-W"), _monday_week(timestamp))
    else:
        chars = {"hour": 13, "day": 10, "month": 7}[period]
        end = {
            "start": {"hour": ":00:00", "day": " 00:00:00", "month": "-01"},
            "short": {"hour": ":00", "day": "", "month": ""},
            "iso": {"hour": ":00", "day": "", "month": ""},
        }[style][period]
        key = F.concat(_iso_text(timestamp, chars), F.lit(end))
    return F.coalesce(key, F.lit("unknown")) if style == "iso" else key


def wall_clock(text: Column) -> Column:
    """Zone-less time read from ISO text; an offset or Z is left aside, bad text gives NULL."""
    pattern = (
        r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(\.\d{1,6})?)?"
        r"(?:Z|[+-]\d{2}:\d{2})?$"
    )
    day = F.regexp_extract(text, pattern, 1)
    minute = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit("00:00"))
    second = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")), F.lit(":00"))
    clean = F.concat(day, F.lit(" "), minute, second, F.regexp_extract(text, pattern, 4))
    return F.when(day != "", clean).try_cast("timestamp_ntz")


def format_time(text: Column, missing: str | None = None) -> Column:
    """ISO text as ``YYYY-MM-DD HH:MM:SS``; unreadable text is shown as it is."""
    shown = F.coalesce(_iso_text(wall_clock(text), 19), text)
    return shown if missing is None else F.coalesce(shown, F.lit(missing))


def show_time(timestamp: Column) -> Column:
    """A typed time as ``YYYY-MM-DD HH:MM:SS``."""
    return _iso_text(timestamp, 19)


# -- urls ------------------------------------------------------------------------------


def url_authority(url: Column) -> Column:
    """Host and port of a url, '' when there is none."""
    return F.coalesce(
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit("")
    )


def domain_of_url(url: Column) -> Column:
    """Host and port without a leading ``www.``; '' for text that is no url."""
    return F.regexp_replace(url_authority(url), r"^www\.", "")


def domain_for_display(domain: Column, url: Column) -> Column:
    """The stored domain, else the host of the url as written."""
    return F.coalesce(F.nullif(domain, F.lit("")), url_authority(url))


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def is_excluded_url(url: Column, parts: list[str]) -> Column:
    """True where any of ``parts`` occurs in the url, in any case."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(F.lower(url), F.lit(part.lower()))
    return found


def web_url_count(links: Column) -> Column:
    """Number of links with an http or https url."""
    return F.size(F.filter(links, lambda link: is_web_url(link["url"]))).cast("long")


# -- text for reports ------------------------------------------------------------------


def truncate_text(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """At most ``chars`` characters, then ``...``; white space before the dots goes."""
    cut = F.rtrim(F.substring(text, 1, chars), F.lit(WHITE_SPACE))
    return F.when(F.length(text) > chars, F.concat(cut, F.lit("..."))).otherwise(
        F.coalesce(text, F.lit(""))
    )


def answer_preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """The first characters and ``...``, nothing trimmed."""
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(F.coalesce(text, F.lit("")))


def escape_markdown(text: Column) -> Column:
    """Put a backslash before every character of ``MARKDOWN_SPECIAL``."""
    members = "".join("\\" + char for char in MARKDOWN_SPECIAL)
    return F.regexp_replace(text, f"([{members}])", r"\\$1")


def format_sources(links: Column, mode: str = "count") -> Column:
    """Links as a number (``count``) or as a JSON list of their urls (``json``)."""
    if mode == "count":
        return F.size(links).cast("string")
    urls = F.transform(links, lambda link: link["url"])
    return F.to_json(F.filter(urls, lambda url: url.isNotNull() & (url != "")))


def fixed_decimals(value: Column, digits: int) -> Column:
    """A number with 1 or 2 decimals, rounded by its exact binary value, halves to even.

    ``format_string`` rounds the shortest decimal text instead and differs on 6.55 or 0.25.
    """
    scale, bits = 10**digits, 58 if digits == 1 else 56
    size = F.abs(value)
    whole = F.floor(size)
    scaled = ((size - whole) * float(1 << bits)).cast("long") * F.lit(scale).cast("long")
    digit = F.shiftright(scaled, bits)
    rest = scaled.bitwiseAND(F.lit((1 << bits) - 1))
    half = 1 << (bits - 1)
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    total = whole * scale + digit + up.cast("long")
    tail = F.lpad((total % scale).cast("string"), digits, "0")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(total / scale).cast("string"), F.lit("."), tail)


def format_bytes(size: Column) -> Column:
    """A size in steps of 1024 with one decimal, B to TB."""
    shown = F.lit(None)
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        text = F.concat(fixed_decimals(size / float(1024**power), 1), F.lit(f" {unit}"))
        shown = text if unit == "TB" else F.when(size < 1024 ** (power + 1), text).otherwise(shown)
    return shown


def safe_name(text: Column) -> Column:
    """Anything but letters and digits becomes ``_``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def export_key(query: Column, timestamp: Column, model: Column) -> Column:
    """Name of a run's own document: time, hash of the prompt, model."""
    moment = F.regexp_replace(show_time(timestamp), "[-:]", "")
    tail = F.concat(F.lit("_"), safe_name(F.nullif(model, F.lit(""))))
    return F.lower(
        F.concat(
            F.lit("result_"),
            F.translate(moment, " ", "_"),
            F.lit("_"),
            F.substring(F.md5(query), 1, 8),
            F.coalesce(tail, F.lit("")),
            F.lit(".json"),
        )
    )


# -- similarity ------------------------------------------------------------------------


def positional_similarity(left: Column, right: Column) -> Column:
    """Share of equal characters at equal places, in terms of the longer text.

    Two empty texts give 1, one empty text gives 0.
    """
    longest = F.greatest(F.length(left), F.length(right))
    shortest = F.least(F.length(left), F.length(right))
    same = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a == b)
    equal = F.size(F.filter(same, lambda hit: hit))
    return (
        F.when(longest == 0, F.lit(1.0))
        .when(shortest == 0, F.lit(0.0))
        .otherwise(equal.cast("double") / longest)
    )
