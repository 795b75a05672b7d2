"""Interrupted transfers: is a source still the same, what is staged intact, was the file finished already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.validate import MAX_CHUNK, MIN_CHUNK
from archivolt.operators.ordered import valid_prefix


def same_source(a: Column, b: Column) -> Column:
    """Whether two journal headers (structs) name the same source in the same state; null-safe field by field."""
    same = F.lit(True)
    for field in ("source", "path", "size", "mtime_ns", "change_id"):
        same = same & a[field].eqNullSafe(b[field])
    return same


def same_header(a: Column, b: Column) -> Column:
    """same_source(), and written with the same chunk size, parity and recipients, in order."""
    same = same_source(a, b)
    for field in ("chunk_size", "parity_m", "recipients"):
        same = same & a[field].eqNullSafe(b[field])
    return same


def staged_valid(staged: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, valid: how many leading shards (keys, j, parity) match their hashes (keys, j, sha256); a missing one ends the run."""
    rows = wanted.join(staged, [*keys, "j"], "left")
    bad = ~F.coalesce(F.sha2("parity", 256) == F.col("sha256"), F.lit(False))
    good = valid_prefix(rows, keys, [F.col("j")], bad).groupBy(*keys).agg(F.count("*").alias("valid"))
    return wanted.select(*keys).distinct().join(good, keys, "left").select(*keys, F.coalesce("valid", F.lit(0)).alias("valid"))


def staged_whole(valid: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """valid with `whole`: all shards of the layout are staged intact and nothing else. sizes: keys, shards, size, staged_size."""
    rows = valid.join(sizes, keys)
    return rows.withColumn("whole", (F.col("valid") == F.col("shards")) & (F.col("size") == F.col("staged_size")))


def parity_resumable(layout: Column, offset: Column, hashes: Column, valid: Column) -> Column:
    """Whether parity can go on at a checkpoint: at the end of a whole window, with every shard before it staged intact."""
    chunks = F.floor(offset / layout["shard_size"])
    whole = (offset % layout["shard_size"] == 0) & (chunks % (layout["k"] * layout["d"]) == 0)
    return whole & (F.size(hashes) == F.floor(chunks / layout["k"]) * layout["m"]) & (F.size(hashes) <= valid)


def finished_earlier(last: Column, size: Column, chunk_size: Column, placed: Column) -> Column:
    """Whether a journal's last checkpoint is the whole file, and it lies in its place at that size already."""
    chunks = F.floor((last["offset"] + chunk_size - 1) / chunk_size)
    whole = last["sha256"].isNotNull() & (last["offset"] == size) & chunk_size.between(MIN_CHUNK, MAX_CHUNK) & (F.size(last["chunks"]) == chunks)
    return F.coalesce(whole & (placed == last["offset"]), F.lit(False))
