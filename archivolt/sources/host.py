"""Captured host tables, and reads of parts of large files on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unescaped(text: Column) -> Column:
    r"""A mount table field with its octal escapes (\040 for a blank) decoded."""
    parts = F.split(text, r"(?=\\[0-3][0-7]{2})")
    plain = F.transform(parts, lambda p: F.when(p.rlike(r"\A\\[0-3][0-7]{2}"), F.concat(F.char(F.conv(F.substring(p, 2, 3), 8, 10).cast("long")), F.substring(p, F.lit(5), F.length(p)))).otherwise(p))
    return F.array_join(plain, "")


def mounts(lines: DataFrame, value: str = "value") -> DataFrame:
    """device, path, kind of the lines of a mount table; lines of fewer than three fields are skipped."""
    fields = F.split(F.trim(value), r"\s+")
    rows = lines.select(fields.alias("f")).where(F.size("f") >= 3)
    return rows.select(unescaped(F.col("f")[0]).alias("device"), unescaped(F.col("f")[1]).alias("path"), F.col("f")[2].alias("kind"))


def key_values(lines: DataFrame, value: str = "value") -> DataFrame:
    """name, n of lines like 'MemTotal:  16 kB' or 'max 5': the first whole number after the name."""
    found = lines.select(F.regexp_extract(value, r"\A([^:\s]+):?\s+(\d+)", 1).alias("name"), F.regexp_extract(value, r"\A([^:\s]+):?\s+(\d+)", 2).alias("n"))
    return found.where("name <> ''").select("name", F.col("n").try_cast("long").alias("n"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for path, at, size in zip(rows["path"], rows["at"], rows["size"]):
            try:
                with Path(path).open("rb") as f:
                    f.seek(at)
                    out.append((path, at, f.read(size), None))
            except OSError as failed:  # one unreadable piece mustn't hide the others
                out.append((path, at, None, type(failed).__name__))
        yield pd.DataFrame(out, columns=["path", "at", "raw", "error"])


def read_ranges(ranges: DataFrame) -> DataFrame:
    """path, at, raw, error for ranges (path, at, size) of files that every executor sees, as a mounted tape: pieces of
    files too large for one row. A read error is a row with its name; a short read gives what there is."""
    return ranges.select("path", F.col("at").cast("long"), F.col("size").cast("long")).mapInPandas(_read, "path string, at long, raw binary, error string")
