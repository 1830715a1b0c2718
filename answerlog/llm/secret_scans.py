"""Secret scans: certain secrets by pattern, weak ones by linking complementary parts.

The base kinds (``assign``, ``access``, ``hex``) are reported wherever they match. Weak
parts (account names, long mixed tokens, endpoints) look like much ordinary text, so they
are reported only where complementary parts co-occur: an identifier with a secret, a
secret with an identifier, an endpoint with both, inside one scope (a paragraph, ended by
an empty line) and with at most ``reach`` code points between them. Parts are joined as
intervals: a part lies in all bins of ``reach`` code points that it covers, a weak one also
in those within ``reach`` of it, so a part meets the parts near it and never all of a text.

DataFrame functions only. Positions come from running sums of the lengths between and of
the matches, so a text with very many matches costs no more than its length; masking joins
overlapping spans by a running maximum and copies each piece of a text once. No pattern
repeats a group without bound, as such a pattern would overflow the stack on long texts.
The parts are found once per distinct text and written to the shared folder.

Defined results: a null text is empty; null, empty and clean texts have no spans; texts of
any length and with any number of matches are taken whole; repeated rows get the same
spans; an empty table gives no rows; other columns pass through, an input column named
like the result is replaced. Masking leaves clean and null texts as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.llm.steps import Steps

# Kinds in the order in which spans of the same start are listed; the first three are the
# base kinds. Per kind: pattern, role.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = {
    "assign": (ASSIGN, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", "ident"),
    "hex": (r"[0-9a-f]{24,}", "secret"),
    "weak_ident": (
        r"""(?i:access_?key|key_?id|client_?id|account|login|user_?name|user|e-?mail)["']?\x20*[:=]\x20*["']?"""
        r"[A-Za-z0-9+/_.@=-]{3,}|(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}"
        r"|[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9-]",
        "ident",
    ),
    "weak_secret": (r"[A-Za-z0-9+/_-]{28,}={0,2}", "secret"),
    "endpoint": (
        r"""[a-z][a-z0-9+.-]{0,15}://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?""",
        "endpoint",
    ),
}
BASE = ["assign", "access", "hex"]
SCOPE_END = r"\n[\x20\t\r]*\n"
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
# One pass that tells whether a text can hold a base span or, with both of its parts, a link.
SECRET_HINT = r"(?i:passw|secret|token|api_?key)|[0-9a-f]{24}|[A-Za-z0-9+/_-]{28}"


def _matches(key: Column, text: Column, kind: str) -> Column:
    """Array of (gap before, match, checked value) of all matches of a kind, in order."""
    pattern = SCOPE_END if kind == "scope" else KINDS[kind][0]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.transform(
        F.arrays_zip(found.alias("match"), value.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("place"),
            x["gap"].cast("long").alias("gap"),
            F.length(x["match"]).cast("long").alias("size"),
            _holds(x["value"], kind).alias("holds"),
        ),
    )
    return parts


def _holds(value: Column, kind: str) -> Column:
    if kind == "assign":
        return F.length(value) >= 6
    if kind == "weak_secret":
        return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return F.lit(True)


def _parts(docs: DataFrame, text: str) -> DataFrame:
    """``key, kind, start, end, scope`` of every match, once per distinct text."""
    body = F.coalesce(F.col(text), F.lit(""))
    able = body.contains("AKIA") | body.rlike(SECRET_HINT)
    rows = docs.select(F.md5(body).alias("key"), body.alias("body")).filter(able)
    every = [_matches(F.col("key"), F.col("body"), kind) for kind in [*KINDS, "scope"]]
    rows = rows.select("key", F.explode(F.concat(*every)).alias("m")).select("key", "m.*")
    rows = rows.dropDuplicates(["key", "kind", "place"])
    before = Window.partitionBy("key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    rows = rows.withColumn("start", F.col("end") - F.col("size")).filter("holds")
    along = Window.partitionBy("key").orderBy("start", "kind", "place").rowsBetween(Window.unboundedPreceding, 0)
    scope = F.sum(F.when(F.col("kind") == "scope", 1).otherwise(0)).over(along)
    return rows.withColumn("scope", scope).filter("kind <> 'scope'").select("key", "kind", "start", "end", "scope")


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts that lie near complementary parts of the same scope."""
    role = reduce(
        lambda rest, kind: F.when(F.col("kind") == kind, F.lit(KINDS[kind][1])).otherwise(rest),
        KINDS, F.lit(None).cast("string"),
    )
    parts = parts.withColumn("role", role)

    def bins(margin: int) -> Column:
        first, last = F.col("start") - margin, F.col("end") - 1 + margin
        return F.explode(F.sequence(F.floor(first / reach), F.floor(last / reach))).alias("bin")

    near = parts.filter("role <> 'endpoint'").select(
        "key", "scope", bins(0), F.col("start").alias("a"), F.col("end").alias("b"), F.col("role").alias("near_role")
    )
    weak = parts.filter(~F.col("kind").isin(*BASE)).select("*", bins(reach))
    pairs = weak.join(near, ["key", "scope", "bin"]).filter(
        F.greatest("start", "a") - F.least("end", "b") <= reach
    )
    ident, secret = F.max(F.col("near_role") == "ident"), F.max(F.col("near_role") == "secret")
    found = pairs.groupBy("key", "kind", "start", "end", "role").agg(ident.alias("ident"), secret.alias("secret"))
    need = (
        F.when(F.col("role") == "ident", F.col("secret"))
        .when(F.col("role") == "secret", F.col("ident"))
        .otherwise(F.col("ident") & F.col("secret"))
    )
    return found.filter(need).select("key", "kind", "start", "end")


def _found(docs: DataFrame, text: str, reach: int) -> DataFrame:
    """``__llm_key, __llm_spans, __llm_cover`` of every distinct text with spans: the spans in
    order, and the stretches that they cover together."""
    parts = Steps(docs.sparkSession, "secrets").saved(_parts(docs, text), "parts")
    spans = parts.filter(F.col("kind").isin(*BASE)).select("key", "kind", "start", "end")
    spans = spans.unionByName(linked(parts, reach))
    along = Window.partitionBy("key").orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", (F.coalesce(reached, F.lit(-1)) <= F.col("start")).cast("int"))
    spans = spans.withColumn("stretch", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.array_position(F.array(*[F.lit(kind) for kind in KINDS]), F.col("kind"))
    one = F.struct("start", rank.alias("rank"), "kind", "end")
    whole = spans.groupBy("key", "stretch").agg(
        F.collect_list(one).alias("some"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    found = whole.groupBy(F.col("key").alias("__llm_key")).agg(
        F.array_sort(F.flatten(F.collect_list("some"))).alias("__llm_spans"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__llm_cover"),
    )
    tidy = F.transform(
        "__llm_spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    )
    return found.withColumn("__llm_spans", tidy)


def _with_found(docs: DataFrame, text: str, reach: int) -> DataFrame:
    keyed = docs.withColumn("__llm_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(_found(docs, text, reach), "__llm_key", "left").drop("__llm_key")


def secret_scans(docs: DataFrame, text: str = "text", reach: int = 200, into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: the spans of each text as (kind, start, end) in code points,
    end exclusive, by start and then in the order of ``KINDS``."""
    result = F.coalesce(F.col("__llm_spans"), F.array().cast(SPANS))
    return _with_found(docs, text, reach).withColumn(into, result).drop("__llm_spans", "__llm_cover")


def listing(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def mask_secrets(
    docs: DataFrame, text: str = "text", reach: int = 200, mask: str = "[SECRET]", chunk: int = 1024
) -> DataFrame:
    """``docs`` with every stretch of spans in ``text`` replaced by ``mask``.

    A text with spans is cut into chunks once; each piece between two stretches is taken
    from the chunks it lies in, so the work grows with the text and not with its square.
    """
    found = _with_found(docs, text, reach).drop("__llm_spans")
    pattern = F.lit(f"(?s).{{1,{chunk}}}")
    cut = F.when(F.col("__llm_cover").isNotNull(), F.regexp_extract_all(text, pattern, F.lit(0)))
    # A generator's columns are computed once; an expression would be computed in every step.
    held = F.inline(F.array(F.struct(cut.alias("__llm_chunks"), F.length(text).cast("long").alias("__llm_size"))))
    rows = found.select("*", held)
    cover = F.col("__llm_cover")

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / chunk).cast("int")
        part = F.slice("__llm_chunks", first + 1, F.floor(end / chunk).cast("int") - first + 1)
        return F.substring(F.array_join(part, ""), (start % chunk + 1).cast("int"), (end - start).cast("int"))

    def end_of(place: Column) -> Column:
        return F.coalesce(F.try_element_at(cover, place)["end"], F.lit(0).cast("long"))

    heads = F.transform(
        cover,
        lambda s, i: F.concat(piece(F.when(i > 0, end_of(F.greatest(i, F.lit(1)))).otherwise(F.lit(0).cast("long")), s["start"]), F.lit(mask)),
    )
    whole = F.concat(F.array_join(heads, ""), piece(end_of(F.lit(-1)), F.col("__llm_size")))
    result = F.when(cover.isNotNull(), whole).otherwise(F.col(text))
    return rows.withColumn(text, result).drop("__llm_cover", "__llm_chunks", "__llm_size")
