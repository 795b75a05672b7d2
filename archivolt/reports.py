"""Reports as lines of text: tapes, listings, search hits, progress. Line formats and words are fixed values that readers rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.scalars import format_bytes
from archivolt.operators.catalog import in_subtree, last_verification, list_totals, tapes_in_order


def day(ns: Column) -> Column:
    """The UTC date of a time in nanoseconds."""
    return F.date_format(F.timestamp_seconds(F.floor(ns / 1_000_000_000)), "yyyy-MM-dd")


def tape_status(v: Column, retired_ns: Column, encryption: Column) -> Column:
    """What a tape's line says of it: the last verification, before it retirement, after it encryption with its keys."""
    found = F.array_compact(F.array(*(F.when(v[k] > 0, F.concat(v[k].cast("string"), F.lit(f" {told}"))) for k, told in (("failed", "FAILED"), ("repairable", "REPAIRABLE"), ("problems", "PROBLEMS")))))
    verified = F.when(v.isNull(), "never verified").otherwise(F.concat(F.lit("verified "), day(v["at_ns"]), F.lit(" "), F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("OK")))
    keys = F.coalesce(encryption["keys"], F.array().cast("array<string>"))
    sealed = F.when(encryption.isNotNull(), F.concat(F.lit(", encrypted"), F.when(F.size(keys) > 0, F.concat(F.lit(" (key "), F.array_join(keys, ", "), F.lit(")"))).otherwise("")))
    return F.concat(F.when(retired_ns.isNotNull(), F.concat(F.lit("RETIRED "), day(retired_ns), F.lit(", "))).otherwise(""), verified, F.coalesce(sealed, F.lit("")))


def tape_lines(tapes: DataFrame, verifications: DataFrame) -> DataFrame:
    """line: label, id, files, bytes and status of each cataloged tape, by label, then id."""
    rows = tapes.join(last_verification(verifications).select(F.col("tape_id").alias("id"), "v"), "id", "left")
    text = F.format_string("%-16s  %s  %8d files  %10s  %s", F.coalesce("label", F.lit("")), "id", "files", format_bytes(F.col("bytes")), tape_status(F.col("v"), F.col("retired_ns"), F.col("encryption")))
    return tapes_in_order(rows).select(text.alias("line"))


def entry_line() -> Column:
    """A listing's line of an entry: hash, size, path, and what is special: a reference, recovered, encrypted (the last that holds)."""
    to = F.concat(F.lit("  -> "), F.col("ref.tape"), F.lit(":"), F.col("ref.path"))
    mark = F.when(F.col("age").isNotNull(), "  (encrypted)").when(F.coalesce("recovered", F.lit(False)), "  (recovered)").when(F.col("ref").isNotNull(), to).otherwise("")
    return F.concat(F.format_string("%s  %12d  %s", "sha256", "size", "path"), mark)


def listing(entries: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(lines of a tape's entries below a folder, in write order; one row with the line of totals)."""
    rows = entries.where(in_subtree(F.col("path"), prefix))
    total = list_totals(rows.withColumn("all", F.lit(1)), ["all"])
    none = rows.sparkSession.range(1).select(F.lit(1).alias("all")).join(total, "all", "left")
    said = F.concat(F.lit("Files: "), F.coalesce("files", F.lit(0)).cast("string"), F.lit("  Bytes: "), format_bytes(F.coalesce("bytes", F.lit(0))))
    return rows.orderBy("segment", "line_no").select(entry_line().alias("line")), none.select(said.alias("line"))


def tape_title(label: Column, tape_id: Column, retired_ns: Column) -> Column:
    """The heading of a tape's hits: its label with its id, or its id alone."""
    name = F.when(F.coalesce(label, F.lit("")) != "", F.concat(label, F.lit(" ("), tape_id, F.lit(")"))).otherwise(tape_id)
    return F.concat(name, F.when(retired_ns.isNotNull(), " (retired)").otherwise(""))


def progress_line(done: Column, total: Column, seconds: Column, width: int = 32) -> Column:
    """A bar, the share done and the rate; a run of nothing is done at once."""
    part = F.when(total > 0, done / total).otherwise(1.0)
    full = F.least(F.floor(part * width), F.lit(width)).cast("int")
    bar = F.concat(F.repeat(F.lit("="), full), F.repeat(F.lit(" "), F.lit(width) - full))
    rate = F.when(seconds > 0, F.floor(done / seconds)).otherwise(0).cast("long")
    return F.concat(F.lit("["), bar, F.lit("] "), F.format_string("%3.0f%%", F.bround(part * 100, 0)), F.lit("  "), format_bytes(rate), F.lit("/s"))
