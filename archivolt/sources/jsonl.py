"""JSON Lines of archive records: strict (the first bad line ends the run) and lenient (bad lines are counted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no (from 1), line. Only LF ends a line; one CR before it goes, empty lines are left out but counted.

    Numbering reads each file as a whole text row, since a split file has no line numbers; manifests are bounded.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = raw.select("file", F.posexplode(F.split("value", "\n", -1)).alias("at", "line"))
    rows = rows.select("file", (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("line", "\r\\z", "").alias("line"))
    return rows.where("line <> ''")


def parsed(rows: DataFrame, schema: T.StructType, problem: Column | None = None) -> DataFrame:
    """file, line_no, the fields, and problem: why the line is refused, or null.

    A line must be one JSON object and nothing more: from_json alone would take `{..} trailing`.
    """
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    x = F.from_json("line", whole, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    out = rows.withColumn("x", x).select("file", "line_no", "line", "x.*")
    shape = F.col("_corrupt_record").isNotNull() | ~F.col("line").rlike(r"\A\s*\{(?s:.*)\}\s*\z") | F.from_json(F.concat(F.lit('{"o":['), "line", F.lit("]}")), "o array<string>")["o"].isNull() | (F.size(F.from_json(F.concat(F.lit('{"o":['), "line", F.lit("]}")), "o array<string>")["o"]) != 1)
    reason = F.when(shape, "not a record")
    if problem is not None:
        reason = F.coalesce(reason, problem)
    return out.withColumn("problem", reason).drop("_corrupt_record", "line")


def read_lenient(spark: SparkSession, path: str | list[str], schema: T.StructType, problem: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows with file and line_no, problems: file, bad lines)."""
    rows = parsed(lines(spark, path), schema, problem)
    bad = rows.where("problem is not null").groupBy("file").agg(F.count("*").alias("bad"))
    return rows.where("problem is null").drop("problem"), bad


def read_strict(spark: SparkSession, path: str | list[str], schema: T.StructType, problem: Column | None = None) -> DataFrame:
    """All rows; using them fails with the number of the first bad line of a file, if there is one."""
    rows = parsed(lines(spark, path), schema, problem)
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("line_no", "problem"))).over(Window.partitionBy("file"))
    rows = rows.withColumn("first", first)
    stop = F.raise_error(F.concat_ws("", F.lit("line "), F.col("first.line_no").cast("string"), F.lit(" of "), "file", F.lit(": "), F.col("first.problem")))
    checked = rows.withColumn("ok", F.when(F.col("first").isNotNull(), stop.cast("boolean")).otherwise(True)).where("ok")
    return checked.drop("problem", "first", "ok")


def encode(rows: DataFrame) -> DataFrame:
    """One JSON line per row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def epoch_ns(text: Column) -> Column:
    """RFC 3339 text as epoch nanoseconds: timestamps keep only microseconds, so the fraction is read from the text."""
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0")
    whole = F.unix_timestamp(F.to_timestamp(F.regexp_replace(text, r"\.\d+", "")))
    return whole * 1_000_000_000 + F.coalesce(F.nullif(fraction, F.lit("")).cast("long"), F.lit(0))
