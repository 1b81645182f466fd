"""Sources: JSON lines (tolerant, diagnostic and strict), plain text, Parquet, id lists, schema previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import is_blank, is_json, json_error, strip

#: What a text scan yields for bytes that are no UTF-8.
BAD_BYTE = "\ufffd"

ANY_CASE_JSONL = "*.[jJ][sS][oO][nN][lL]"


def read_lines(spark: SparkSession, path: str, pattern: str | None = None, drop_bad_bytes: bool = False, blocks: bool = False) -> DataFrame:
    """(file, line): every line; `pattern` filters the files of a folder by name, not recursively.

    Bad bytes are read as U+FFFD; drop_bad_bytes removes those (and genuine U+FFFD). With `blocks`
    there is also `block`, the place in the file where the line's split begins.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    block = [F.col("_metadata.file_block_start").alias("block")] if blocks else []
    lines = reader.text(path).select(F.col("_metadata.file_name").alias("file"), *block, F.col("value").alias("line"))
    # a scan decodes bad bytes only where a value is looked at: a regular expression does so
    return lines.withColumn("line", F.regexp_replace("line", BAD_BYTE, "")) if drop_bad_bytes else lines


def numbered(lines: DataFrame) -> DataFrame:
    """Line numbers from 1 in each file, for lines with their blocks (block is left out).

    Lines are counted and numbered by split, so a task holds one split's lines and not a file's; the
    splits' counts are then summed up by file. File names are taken to differ.
    """
    placed = lines.withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn("__in", F.row_number().over(W.partitionBy("file", "block").orderBy("__at")))
    before = W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    counts = lines.groupBy(F.col("file").alias("__file"), F.col("block").alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = placed.join(counts, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return joined.withColumn("line_no", F.col("__before") + F.col("__in")).drop("__at", "__in", "__file", "__block", "__n", "__before", "block")


def valid_json(lines: DataFrame) -> DataFrame:
    """Tolerant: blank and invalid lines are left out; the raw line stays, stripped."""
    return lines.where(~is_blank(F.col("line")) & is_json(F.col("line"))).withColumn("line", strip(F.col("line")))


def invalid_json(lines: DataFrame) -> DataFrame:
    """Diagnostic: the non-blank lines that are no JSON, for a quarantine table."""
    return lines.where(~is_blank(F.col("line")) & ~is_json(F.col("line")))


def quarantined(lines: DataFrame) -> DataFrame:
    """Diagnostic: the non-blank lines that are no JSON, with what a full parser says against them."""
    return invalid_json(lines).withColumn("error", json_error(F.col("line")))


def strict_json(lines: DataFrame) -> DataFrame:
    """Strict: an invalid line fails the job; blank lines are left out."""
    kept = lines.where(~is_blank(F.col("line")))
    return kept.withColumn("line", F.when(is_json(F.col("line")), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("invalid JSON: "), F.substring("line", 1, 200)))))


def line_statistics(lines: DataFrame) -> DataFrame:
    """Raw, skipped and valid lines for each file."""
    valid = ~is_blank(F.col("line")) & is_json(F.col("line"))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("raw"), F.count_if(~valid).alias("skipped"), F.count_if(valid).alias("valid"))


def text_field(lines: DataFrame, field: str = "text") -> DataFrame:
    """Strict: the string field of each JSON object; a line that is invalid or lacks it fails the job."""
    value = F.try_variant_get(F.try_parse_json("line"), f"$.{field}", "string")
    return lines.where(~is_blank(F.col("line"))).select("file", F.coalesce(value, F.raise_error(F.concat(F.lit(f"no {field} in "), F.substring("line", 1, 200))).cast("string")).alias(field))


def typed_json(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Lines as columns of a schema; values of other types, and lines that are no objects, are null."""
    return lines.select("file", F.from_json("line", schema).alias("record")).select("file", "record.*")


def chat_records(lines: DataFrame) -> DataFrame:
    """Strict: (file, messages) of each line; an invalid line fails the job.

    Messages that are no objects are left out; a role or content that is no text is null, as are messages that are no list.
    """
    messages = F.try_variant_get(F.try_parse_json("line"), "$.messages", "array<variant>")
    objects = F.filter(messages, lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    field = lambda m, name: F.try_variant_get(m, f"$.{name}", "variant")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    typed = F.transform(objects, lambda m: F.struct(text(field(m, "role")).alias("role"), text(field(m, "content")).alias("content")))
    return strict_json(lines).select("file", typed.alias("messages"))


def field_union(lines: DataFrame) -> DataFrame:
    """Names of the top-level keys of all JSON objects, with how many lines have them."""
    return lines.select(F.explode(F.array_distinct(F.json_object_keys("line"))).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n_lines"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Files of different columns are read with the union of them."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*columns) if columns else df


def read_ids(spark: SparkSession, path: str, name: str = "doc_id") -> DataFrame:
    """A list of integers, one a line; blank lines are left out, repeats fall together."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("long").alias(name)).distinct()


def preview(df: DataFrame, rows: int = 2) -> tuple[str, DataFrame]:
    """The schema as text, and the first rows."""
    return df.schema.simpleString(), df.limit(rows)
