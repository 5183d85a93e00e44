"""Readers and writers (S1-S6) and input validation.

All inputs go through Spark's splittable readers (Parquet, JSON Lines,
text); JSON arrays are cut into elements by byte ranges (``json_array``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maieutic.functions.text_rules import strip_text
from maieutic.operators.compare import f1_summary
from maieutic.sources import json_array


class InputError(ValueError):
    """Raised for rejected input in strict mode (P5)."""


# --- S1, P14 --------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None,
               splits: Sequence[str] | None = None, split_col: str = "split") -> DataFrame:
    """A named table; with ``splits`` only those values of ``split_col`` (pushed to the scan)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if splits is not None:
        df = df.where(F.col(split_col).isin(list(splits)))
    return df


# --- S2, S3 ----------------------------------------------------------------------------
def detect_json_layout(spark: SparkSession, path: str) -> str:
    """``array`` or ``lines`` by the first non-blank character of each file; ``mixed`` if files differ, ``empty`` if all are blank.

    Only the first block of each file is read.
    """
    arrays = {mark == "[" for mark in json_array.first_marks(spark, path).values() if mark}
    if not arrays:
        return "empty"
    return "mixed" if len(arrays) == 2 else "array" if True in arrays else "lines"


def read_json_records(spark: SparkSession, path: str, layout: str = "auto",
                      schema: StructType | str | None = None) -> DataFrame:
    """Records from JSON array files or JSON Lines (S2, S3); blank input -> no rows.

    ``auto`` looks at the first non-blank character of every file; a folder that
    mixes both layouts is an error, because one reader would lose rows of the other.  Lines
    are split by ``\n`` only; blank lines are skipped by the reader.  An array of any size is read by many tasks;
    one that is not complete is an error.
    """
    if layout == "auto":
        layout = detect_json_layout(spark, path)
    if layout == "mixed":
        raise InputError("the folder mixes JSON arrays and JSON Lines; read them apart")
    if layout == "empty":
        if schema is None:
            return spark.createDataFrame([], "value string").limit(0)
        return spark.createDataFrame([], schema)
    if layout == "array":
        try:
            return json_array.read_array(spark, path, schema)
        except ValueError as e:
            raise InputError(str(e)) from e
    if layout != "lines":
        raise ValueError("layout must be 'auto', 'array' or 'lines'")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


# --- S4, P3, P4, P5 ----------------------------------------------------------------------
BAD_JSON, NOT_A_LIST = "not valid JSON", "the file is not a JSON array"
WRONG_TYPE, NO_FIELD = "neither a text nor an object", "neither a prompt nor a question"


def drop_blank_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """Lines with something other than blanks."""
    return lines.where(F.length(strip_text(F.col(col))) > 0)


def pick_prompt(prompt, question):
    """First non-empty of ``prompt`` / ``question``, then stripped.

    The emptiness test comes before the strip: ``"  "`` is kept and becomes ``""``.
    """
    p = F.coalesce(F.nullif(prompt, F.lit("")), F.nullif(question, F.lit("")))
    return strip_text(p)


def _field_text(v: str, name: str):
    """A text, number or boolean field of a variant as text; null for lists, objects, nulls, zero and false."""
    field = F.try_variant_get(v, f"$.{name}", "variant")
    kind = F.coalesce(F.schema_of_variant(field), F.lit(""))
    text = F.try_variant_get(v, f"$.{name}", "string")
    number = F.try_variant_get(v, f"$.{name}", "double")
    return F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.when(text == "true", F.lit("True"))).when(
        kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.when(number != 0, text))


def read_prompts(spark: SparkSession, path: str, fmt: str | None = None, strict: bool = True):
    """Prompts of ``.txt`` / ``.jsonl`` / ``.json`` files as ``(prompt_id, prompt)``.

    * txt: one prompt per line, stripped, blank lines dropped (P3).
    * jsonl: one object per line, ``prompt`` or else ``question`` (P4).
    * json: an array of strings or of such objects, of any size (``json_array``).
    A field that is a number or a boolean is taken as its text (``True`` and ``False`` for booleans); zero and false count as empty.
    ``prompt_id`` ascends in file order but is not dense.  Anything else is a reject (P5): ``strict`` raises ``InputError``;
    otherwise ``(prompts, rejects)`` is returned, rejects with a ``reason``.  An array element that is not JSON is one reject,
    a file that is no complete array another.  An input without any prompt is an error in strict mode.
    """
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt not in ("txt", "jsonl", "json"):
        raise ValueError(f"prompts are read from txt, jsonl and json files, not {fmt!r}")
    at = F.monotonically_increasing_id().alias("prompt_id")
    if fmt == "json":
        elements, files = json_array.array_elements(spark, path)
        place = F.shiftleft(F.col("file").cast("long"), 44) + F.col("at")  # files below 16 TB
        items = elements.select(place.alias("prompt_id"), F.try_parse_json("element").alias("v"))
        others = files.where("NOT ok AND mark IS NOT NULL").select(F.shiftleft(F.col("file").cast("long"), 44).alias("prompt_id"), "path", "mark")
        outer = others.where("mark = '['").select("prompt_id", F.lit(BAD_JSON).alias("reason"))
        plain = [r["path"] for r in others.where("mark <> '['").select("path").collect()]
        if plain:  # no arrays: whether they are JSON at all is for the whole-file reader to say
            values = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(plain)
            values = values.select(F.col("_metadata.file_path").alias("path"), F.when(F.col("v").isNull(), F.lit(BAD_JSON)).otherwise(F.lit(NOT_A_LIST)).alias("reason"))
            outer = outer.unionByName(others.join(values, "path").select("prompt_id", "reason"))
    else:
        lines = drop_blank_lines(spark.read.option("lineSep", "\n").text(path).select(at, F.col("value").alias("line")))
        outer = None
        if fmt == "jsonl":
            items = lines.select("prompt_id", F.try_parse_json("line").alias("v"))
    if fmt == "txt":
        rows = lines.select("prompt_id", strip_text(F.col("line")).alias("prompt"), F.lit(None).cast("string").alias("reason"))
    else:
        kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
        is_object, is_text = kind.startswith("OBJECT"), (kind == "STRING") & F.lit(fmt == "json")
        prompt = F.when(is_text, strip_text(F.try_variant_get("v", "$", "string"))).when(
            is_object, pick_prompt(_field_text("v", "prompt"), _field_text("v", "question")))
        reason = F.when(F.col("v").isNull(), F.lit(BAD_JSON)).when(~(is_object | is_text), F.lit(WRONG_TYPE)).when(
            F.col("prompt").isNull(), F.lit(NO_FIELD))
        rows = items.withColumn("prompt", prompt).select("prompt_id", "prompt", reason.alias("reason"))
    good = rows.where("reason IS NULL").select("prompt_id", "prompt")
    bad = rows.where("reason IS NOT NULL").select("prompt_id", "reason")
    bad = bad.unionByName(outer) if outer is not None else bad
    if strict:
        first = bad.first()
        if first is not None:
            raise InputError(f"{path}: {first['reason']}")
        if good.isEmpty():
            raise InputError(f"{path}: no prompts")
        return good
    return good, bad


# --- S5, S6 ----------------------------------------------------------------------------
def write_comparison_report(scored: DataFrame, path: str, header: dict | None = None, mode: str = "overwrite") -> None:
    """Comparison report (S5): detail rows as JSON Lines under ``path/results``, and the one-row
    summary (plus header fields) of what was written under ``path/summary``.

    The scored join runs once; details are never gathered into one array.
    """
    cols = [c for c in ("id", "prompt", "trained_output", "baseline_output", "f1_metrics") if c in scored.columns]
    details = scored.select(*cols)
    details.write.mode(mode).json(f"{path}/results")
    back = scored.sparkSession.read.schema(details.schema).json(f"{path}/results")
    summary = f1_summary(back.select(F.col("f1_metrics.f1").alias("f1")))
    for k, v in (header or {}).items():
        summary = summary.withColumn(k, F.lit(v))
    summary.coalesce(1).write.mode(mode).json(f"{path}/summary")


def write_metric_log(rows: DataFrame, path: str, partition_cols: Sequence[str] = ("run_id",),
                     mode: str = "append") -> None:
    """Append ``(ids..., metric, value)`` rows to a partitioned Parquet metrics table."""
    rows.write.mode(mode).partitionBy(*partition_cols).parquet(path)


# --- P1, P2 ----------------------------------------------------------------------------
def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct columns to dotted top-level names, one level per call site recursion."""
    def walk(prefix, dtype, path):
        if isinstance(dtype, StructType):
            out = []
            for f in dtype.fields:
                out.extend(walk(f"{prefix}{sep}{f.name}", f.dataType, path.getField(f.name)))
            return out
        return [path.alias(prefix)]

    cols = []
    for f in df.schema.fields:
        cols.extend(walk(f.name, f.dataType, F.col(f"`{f.name}`")))
    return df.select(*cols)


def keep_columns(df: DataFrame, produced: Sequence[str]) -> DataFrame:
    """Keep only the produced columns (P2); Catalyst prunes the scan accordingly."""
    return df.select(*produced)
