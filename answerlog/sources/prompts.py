"""Prompt batches: reading, validating and filling in defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.functions.scalars import strip
from answerlog.operators.aliases import MODEL_ALIASES
from answerlog.session import pin, with_dense_index


def read_prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Prompts kept as one JSON text per line: ``idx, raw``. Splits over any number of tasks."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"))
    placed = lines.filter(strip(F.col("raw")) != "").withColumns(
        {
            "file": F.col("_metadata.file_path"),
            "block": F.col("_metadata.file_block_start"),
            "place": F.monotonically_increasing_id(),
        }
    )
    order = [F.col("file"), F.col("block"), F.col("place")]
    return with_dense_index(placed, order, "idx").select("idx", "raw")


def read_prompt_files(spark: SparkSession, path: str | list[str], max_prompts: int | None = None) -> DataFrame:
    """Files that each hold a JSON array of prompts: ``file, content, error_code``.

    A batch file is one JSON value and is parsed as one; many files are read in parallel.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("content")
    )
    shape = F.schema_of_variant("content")
    size = F.json_array_length(F.to_json("content"))
    code = (
        F.when(F.col("content").isNull(), "invalid_json")
        .when(~shape.startswith("ARRAY"), "not_an_array")
        .when(size == 0, "empty")
    )
    if max_prompts is not None:
        code = code.when(size > max_prompts, "too_many")
    return files.withColumn("error_code", code)


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the pieces of a file before each one. Sums run
    inside the blocks that files are read in; of each block only its total goes further."""
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_value", value.cast("long")).withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    totals = rows.groupBy("file", "block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    joined = rows.join(starts, ["file", "block"])
    return joined.withColumn(name, F.col("_start") + F.col("_inside")).drop("_value", "_inside", "_start")


def split_prompt_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries ``file, idx, raw`` of files that each hold one JSON array, and ``file,
    error_code`` of all files; a file is read by as many tasks as it has blocks.

    The text is cut after every closing brace. Counts of quotes before a piece tell whether
    it begins inside a string, and counts of brackets outside strings how deep it lies, so
    running sums tell where an entry of the array ends; what lies between two such places is
    parsed by itself. Codes and entries are those of :func:`read_prompt_files`, which judges
    the files that do not begin with ``[``. Entries of a file with an error are left out;
    entries that are no objects are parsed with the next object.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").alias("piece"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )
    read = pin(read)
    last = read.groupBy("file").agg(F.max(F.struct("block", "place")).alias("end"))
    rows = read.join(F.broadcast(last), "file").withColumn("ends", F.struct("block", "place") == F.col("end"))
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"')
    rows = rows.withColumn("quotes", F.size(parts) - 1)
    rows = _running(rows, F.col("quotes"), "before")

    outside = F.array_join(F.filter(parts, lambda x, i: (i + F.col("before")) % 2 == 0), "")
    closed = ~F.col("ends") & ((F.col("quotes") + F.col("before")) % 2 == 0)
    depth = F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))
    rows = rows.withColumn("closed", closed).withColumn("deeper", depth - F.col("closed").cast("int"))
    rows = _running(rows, F.col("deeper"), "depth")
    rows = rows.withColumn("after", F.col("depth") + F.col("deeper"))
    rows = _running(rows, F.col("closed") & (F.col("after") == 1), "number")

    text = F.concat("piece", F.when(F.col("ends"), "").otherwise("}"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "place", text.alias("text"))))
    whole = F.array_join(F.transform(ordered, lambda x: x["text"]), "")
    open_string = (F.col("before") + F.col("quotes")) % 2 != 0
    odd = F.max(F.when(F.col("ends"), (F.col("after") != 0) | open_string).otherwise(F.col("after") < 1))
    chunks = rows.groupBy("file", "number").agg(whole.alias("chunk"), F.max("ends").alias("ends"), odd.alias("odd"))
    first, ends = F.col("number") == 0, F.col("ends")
    array = F.regexp_extract("chunk", r"^\s*(.)", 1) == "["
    comma = F.col("chunk").rlike(r"^\s*,")
    body = F.regexp_replace("chunk", r"^\s*[\[,]", "")
    body = F.when(ends, F.regexp_replace(body, r"\]\s*$", "")).otherwise(body)
    blank = body.rlike(r"^\s*$")
    # Inside an object, as text behind a whole value would be passed over.
    held = F.try_parse_json(F.concat(F.lit('{"x":['), body, F.lit("]}")))
    entries = F.try_variant_get(held, "$.x", "variant")
    sound = F.when(blank, first | ~comma).otherwise((first | comma) & entries.isNotNull())
    sound = sound & ~F.col("odd") & (~ends | F.col("chunk").rlike(r"\]\s*$"))
    judged = pin(chunks.select(
        "file", "number", entries.alias("entries"),
        F.when(first, ~array).otherwise(F.lit(False)).alias("other"), (sound | (first & ~array)).alias("sound"),
        F.when(blank | entries.isNull(), 0).otherwise(F.json_array_length(F.to_json(entries))).alias("size"),
    ).withColumn("entries", F.to_json("entries")))
    code = F.when(F.max("other"), "not_an_array").when(~F.min("sound"), "invalid_json").when(F.sum("size") == 0, "empty")
    files = pin(judged.groupBy("file").agg(code.alias("error_code")))
    good = judged.join(F.broadcast(files.filter("error_code IS NULL").select("file")), "file").filter("size > 0")
    each = good.select("file", "number", F.posexplode(F.from_json("entries", "array<variant>")).alias("pos", "entry"))
    listed = each.select("file", "number", "pos", F.to_json("entry").alias("raw"))
    numbered = with_dense_index(listed, [F.col("file"), F.col("number"), F.col("pos")], "at")
    others = [r["file"] for r in files.filter("error_code = 'not_an_array'").collect()]
    if others:  # whether they are JSON at all is told by the whole text
        whole = read_prompt_files(spark, others).select("file", "error_code")
        files = files.filter("error_code IS NULL OR error_code <> 'not_an_array'").unionByName(whole)
    starts = numbered.groupBy("file").agg(F.min("at").alias("start"))
    placed = numbered.join(F.broadcast(starts), "file")
    return placed.select("file", (F.col("at") - F.col("start")).cast("int").alias("idx"), "raw"), files


def prompts_of_files(files: DataFrame) -> DataFrame:
    """Entries of the sound batch files: ``file, idx, raw``."""
    sound = files.filter(F.col("error_code").isNull())
    entries = F.from_json(F.to_json("content"), "array<variant>")
    return sound.select("file", F.posexplode(entries).alias("idx", "entry")).select(
        "file", "idx", F.to_json("entry").alias("raw")
    )


def _field(entry: Column, name: str) -> Column:
    return F.try_variant_get(entry, f"$.{name}", "variant")


def _text(entry: Column, name: str) -> Column:
    return strip(F.try_variant_get(entry, f"$.{name}", "string"))


def validate_prompts(prompts: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Check every prompt; the first rule that fails gives ``error_code``, NULL means valid.

    Types are those of the JSON text, so it is read as a variant. ``query`` and ``model``
    come back trimmed; inner white space stays.
    """
    known = list(MODEL_ALIASES) if models is None else models
    entry = F.col("_entry")

    def kind(name: str) -> Column:
        return F.schema_of_variant(_field(entry, name))

    read = prompts.withColumn("_entry", F.try_parse_json("raw"))
    code = (
        F.when(entry.isNull(), "invalid_json")
        .when(~F.schema_of_variant(entry).startswith("OBJECT"), "not_an_object")
        .when(_field(entry, "query").isNull(), "query_missing")
        .when(kind("query") != "STRING", "query_not_string")
        .when(_text(entry, "query") == "", "query_empty")
        .when(kind("model") != "STRING", "model_not_string")
        .when(~_text(entry, "model").isin(known), "model_unknown")
        .when(kind("no_screenshot") != "BOOLEAN", "no_screenshot_not_boolean")
    )
    shot = F.try_variant_get(entry, "$.no_screenshot", "boolean")
    verdict = F.struct(
        code.alias("error_code"),
        _text(entry, "query").alias("query"),
        _text(entry, "model").alias("model"),
        shot.alias("no_screenshot"),
    )
    # A generator's output is computed once; a filter on the code does not repeat the checks.
    checked = read.select(*prompts.columns, F.inline(F.array(verdict)))
    valid = F.col("error_code").isNull()
    return checked.withColumns(
        {name: F.when(valid, F.col(name)) for name in ("query", "model", "no_screenshot")}
    )


def split_prompts(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid prompts, and the rejected ones with their reason."""
    valid = checked.filter(F.col("error_code").isNull()).drop("error_code")
    rejected = checked.filter(F.col("error_code").isNotNull()).select("idx", "raw", "error_code")
    return valid, rejected


def apply_defaults(
    valid: DataFrame,
    model: str | None = None,
    no_screenshot: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Fill absent settings from the batch; keep the first ``limit`` prompts if given."""
    first = valid if limit is None else valid.orderBy("idx").limit(limit)
    return first.withColumns(
        {
            "model": F.coalesce("model", F.lit(model).cast("string")),
            "no_screenshot": F.coalesce("no_screenshot", F.lit(no_screenshot)),
        }
    )
