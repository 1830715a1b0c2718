"""Row predicates over the results table, each a single ``Column``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlog.functions.scalars import source_count

DAY = "dt"  # the daily partitions of a stored log
SEARCH_COLUMNS = {"answers": "answer_text", "sources": "sources", "queries": "query"}


def check_limit(limit: int | None) -> None:
    """Limits are positive whole numbers."""
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0):
        raise ValueError(f"limit must be a positive integer, got {limit!r}")


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions that were given."""
    result = F.lit(True)
    for condition in conditions:
        if condition is not None:
            result = result & condition
    return result


def contains_text(column: Column, term: str, case_sensitive: bool = False) -> Column:
    """Literal substring test; wildcards in the term mean themselves."""
    if case_sensitive:
        return F.contains(column, F.lit(term))
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def like_pattern(column: Column, pattern: str) -> Column:
    """``LIKE`` with ``%`` and ``_``, in any case; a backslash is an ordinary character."""
    return F.ilike(column, F.lit(pattern), F.lit("\x00"))


def parse_date(text: str) -> datetime | None:
    """A ``YYYY-MM-DD`` date, or None for other text."""
    try:
        return datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        return None


def instant(value: str | datetime) -> Column:
    """A point in time from ISO text or a datetime; the zone is left aside."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return F.lit(str(value.replace(tzinfo=None))).cast("timestamp_ntz")


def time_window(
    timestamp: Column,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    end_mode: str = "instant",
) -> Column:
    """Inclusive time range; an empty bound is no bound.

    ``instant``: both bounds are points in time, a bare date is its midnight.
    ``end_of_day``: bounds are dates, the end reaches to 23:59:59; other text is ignored.
    ``date``: bounds are dates compared with the calendar date; rows without time stay.
    """
    if end_mode == "instant":
        low = timestamp >= instant(start) if start else None
        high = timestamp <= instant(end) if end else None
        return all_of([low, high])
    if end_mode == "end_of_day":
        first, last = parse_date(start or ""), parse_date(end or "")
        low = timestamp >= instant(first) if first else None
        high = timestamp <= instant(last.replace(hour=23, minute=59, second=59)) if last else None
        return all_of([low, high])
    if end_mode == "date":
        for text in (start, end):
            if text and parse_date(text) is None:
                raise ValueError(f"dates are YYYY-MM-DD, got {text!r}")
        day = timestamp.cast("date")
        low = day >= F.lit(start).cast("date") if start else None
        high = day <= F.lit(end).cast("date") if end else None
        return timestamp.isNull() | all_of([low, high])
    raise ValueError(f"unknown end_mode {end_mode!r}")


def within(
    results: DataFrame,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    end_mode: str = "instant",
) -> Column:
    """:func:`time_window` over the runs' time; on a log that is read with its daily
    partitions also a bound on these, so other days are not read."""
    window = time_window(F.col("timestamp"), start, end, end_mode)
    if DAY not in results.columns:
        return window

    def day_of(value: str | datetime | None) -> Column | None:
        if end_mode == "end_of_day":
            value = parse_date(value or "")
        if not value:
            return None
        moment = datetime.fromisoformat(value) if isinstance(value, str) else value
        return F.lit(moment.replace(tzinfo=None).date())

    low, high = day_of(start), day_of(end)
    if low is None and high is None:
        return window
    days = all_of(
        [F.col(DAY) >= low if low is not None else None]
        + [F.col(DAY) <= high if high is not None else None]
    )
    return window & (F.col(DAY).isNull() | days if end_mode == "date" else days)


def value_range(value: Column, low: float | None, high: float | None) -> Column:
    """Inclusive range; a bound that is not given does not restrict."""
    return all_of(
        [value >= F.lit(low) if low is not None else None]
        + [value <= F.lit(high) if high is not None else None]
    )


def has_sources(raw: Column, mode: str = "parsed") -> Column:
    """Whether a run cites links.

    ``parsed``: the JSON list holds at least one entry; ``not_empty_list``: any text but
    ``[]``; ``not_blank``: any text but ``''``. Always true or false.
    """
    if mode == "parsed":
        return source_count(raw) > 0
    if mode == "not_empty_list":
        return raw.isNotNull() & (raw != "[]")
    if mode == "not_blank":
        return raw.isNotNull() & (raw != "")
    raise ValueError(f"unknown mode {mode!r}")


def search_term(
    term: str, search_in: str = "answers", case_sensitive: bool = False, model: str | None = None
) -> Column:
    """The term in answers, sources, queries or any of them, for one model if given."""
    if search_in != "all" and search_in not in SEARCH_COLUMNS:
        raise ValueError(f"search_in must be all or one of {sorted(SEARCH_COLUMNS)}")
    names = list(SEARCH_COLUMNS.values()) if search_in == "all" else [SEARCH_COLUMNS[search_in]]
    found = F.lit(False)
    for name in names:
        found = found | F.coalesce(contains_text(F.col(name), term, case_sensitive), F.lit(False))
    return found & equals_model(model) if model else found


def equals_model(model: str | None) -> Column:
    """Rows of one model; an empty name is no restriction."""
    return F.col("model") == F.lit(model) if model else F.lit(True)
