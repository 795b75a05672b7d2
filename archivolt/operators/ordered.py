"""Order-dependent computations: ranges, deltas, changes, greedy accepts, reset accumulators, prefixes, last and first wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.shared import written


def _up_to_here(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def bad_ranges(bad: DataFrame, keys: list[str], chunk: str, chunk_size: Column, size: Column) -> DataFrame:
    """keys, ranges: consecutive bad chunk indexes merged into inclusive byte ranges 'from-to', ', ' between them.

    The end of a range is capped at the file's size. Repeated indexes count once.
    """
    rows = bad.select(*keys, F.col(chunk).cast("long").alias("i"), chunk_size.alias("cs"), size.alias("size")).distinct()
    island = F.col("i") - F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    spans = rows.withColumn("island", island).groupBy(*keys, "island").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.max("cs").alias("cs"), F.max("size").alias("size"))
    first = F.col("lo") * F.col("cs")
    text = F.concat_ws("-", first.cast("string"), (F.least((F.col("hi") + 1) * F.col("cs"), "size") - 1).cast("string"))
    spans = spans.withColumn("span", F.struct(first.alias("at"), text.alias("text")))
    told = F.array_join(F.transform(F.array_sort(F.collect_list("span")), lambda s: s["text"]), ", ")
    return spans.groupBy(*keys).agg(told.alias("ranges"))


def since_baseline(rows: DataFrame, keys: list[str], order: list[Column], counters: list[str]) -> DataFrame:
    """Adds <counter>_since: the rise over the first row of the group; null if either is missing or the counter fell below it."""
    w = _up_to_here(keys, order)
    for c in counters:
        base = F.first(c).over(w)
        rows = rows.withColumn(f"{c}_since", F.when(F.col(c) >= base, F.col(c) - base))
    return rows


def since_previous(rows: DataFrame, keys: list[str], order: list[Column], counters: list[str]) -> DataFrame:
    """As since_baseline(), over the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    for c in counters:
        before = F.lag(c).over(w)
        rows = rows.withColumn(f"{c}_step", F.when(F.col(c) >= before, F.col(c) - before))
    return rows


def changes(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """The rows whose value differs from the one before in their group, with it as `was`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("was", F.lag(value).over(w)).where(F.col("was").isNotNull() & ~F.col(value).eqNullSafe(F.col("was")))


def link_changes(polls: DataFrame, drive: str = "drive", ts: str = "ts", link: str = "link", rate: str = "rate") -> DataFrame:
    """Transitions of links seen at a drive's first poll: (drive, ts, link, was, now); now is null when it is no longer reported.

    A link that vanishes is told once and then forgotten, even if it returns; links that appear later are not adopted.
    polls: one row per poll and link; a poll without links is a row of a null link.
    """
    times = polls.select(drive, ts).distinct()
    first = times.groupBy(drive).agg(F.min(ts).alias("t0"))
    adopted = polls.join(first, drive).where((F.col(ts) == F.col("t0")) & F.col(link).isNotNull()).select(drive, link)
    grid = times.join(adopted, drive).join(polls.select(drive, ts, link, rate), [drive, ts, link], "left")
    grid = grid.withColumn("gone", F.sum(F.col(rate).isNull().cast("int")).over(_up_to_here([drive, link], [F.col(ts)])))
    grid = grid.withColumn("was", F.lag(rate).over(Window.partitionBy(drive, link).orderBy(ts)))
    told = F.col("was").isNotNull() & (F.col("gone") <= 1) & (F.col(rate).isNull() & (F.col("gone") == 1) | (F.col("gone") == 0) & (F.col(rate) != F.col("was")))
    return grid.where(told).select(drive, ts, link, "was", F.col(rate).alias("now"))


def accepted_copies(rows: DataFrame, keys: list[str], order: list[Column], ok: Column, content: str, tape: str, copies: Column) -> DataFrame:
    """The greedy accept of records in order: the first that qualifies fixes the content, each tape counts once, enough is enough.

    Returns the accepted rows with `rank` 1 .. copies. Set form: the content of the first qualifying row, rows of that
    content, the first of each tape, the first `copies` of those.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.where(ok).withColumn("fixed", F.first(content).over(w)).where(F.col(content) == F.col("fixed"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, tape).orderBy(*order))).where("nth = 1")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= copies).drop("nth", "fixed")


def _flushed(keys: list[str], size: str, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, segment = None, 0, 1
        for batch in batches:
            sizes = pc.fill_null(batch.column(size), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            out = np.empty(len(names), np.int32)
            for a, b in zip(cuts, cuts[1:]):
                if names[a] != group:
                    group, held, segment = names[a], 0, 1
                total = np.cumsum(sizes[a:b])
                at, gone = 0, -held  # rows told, and the sum at the last flush
                while at < b - a:
                    full = max(at, int(np.searchsorted(total, gone + threshold)))
                    out[a + at : a + min(full + 1, b - a)] = segment
                    if full >= b - a:
                        break
                    gone, segment, at = int(total[full]), segment + 1, full + 1
                held = int(total[-1]) - gone
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "segment"])

    return run


def flush_segments(rows: DataFrame, keys: list[str], order: str, size: str, threshold: int) -> DataFrame:
    """Adds `segment` (from 1): a new one begins after the row at which the bytes since the last flush reach threshold.

    The counter starts again at 0 with each flush, which no running sum modulo threshold expresses. Each group (a tape) is
    sorted in one partition and read once, batch by batch; nothing but the counter is held. Rows of equal order are taken in
    the order of their size. A null size counts 0.
    """
    lined = rows.withColumn(size, F.col(size).cast("long")).repartition(*keys).sortWithinPartitions(*keys, order, size)
    return lined.mapInArrow(_flushed(keys, size, threshold), T.StructType([*lined.schema.fields, T.StructField("segment", T.IntegerType())]))


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `part`, written: ranges of the order, numbered in it. Rows of equal order are in one range."""
    return written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")


def running_total(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of a value (long) over all rows up to each, in an order of the whole table.

    The table is dealt out by ranges of the order; the ranges' sums, a row each, are added up first, so no task sorts more
    than its range. order: columns that tell all rows apart, or rows that are alike in all that counts.
    """
    parts = ranged(rows.withColumn("__value", value.cast("long")), order)
    sums = parts.groupBy("part").agg(F.sum("__value").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("part", before.alias("__before"))  # a row for each shuffle partition
    inside = F.sum("__value").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(sums), "part").withColumn(name, F.col("__before") + inside).drop("part", "__value", "__before")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place (from 1) in an order of the whole table; see running_total()."""
    return running_total(rows, order, F.lit(1), name)


def valid_prefix(rows: DataFrame, keys: list[str], order: list[Column], bad: Column) -> DataFrame:
    """The rows before the first bad one of each group."""
    n = F.sum(bad.cast("int")).over(_up_to_here(keys, order))
    return rows.withColumn("__bad", F.coalesce(n, F.lit(0))).where("__bad = 0").drop("__bad")


def torn_tail(rows: DataFrame, keys: list[str], order: str, bad: Column) -> DataFrame:
    """keys, torn, damaged_at: a bad last row is a torn tail, to be cut; a bad row before it is damage (its least order)."""
    told = rows.select(*keys, F.col(order).alias("o"), bad.alias("bad")).groupBy(*keys).agg(F.max("o").alias("last"), F.min(F.when(F.col("bad"), F.col("o"))).alias("first_bad"), F.max(F.when(F.col("bad"), F.col("o"))).alias("last_bad"))
    return told.select(*keys, F.coalesce(F.col("last_bad") == F.col("last"), F.lit(False)).alias("torn"), F.when(F.col("first_bad") < F.col("last"), F.col("first_bad")).alias("damaged_at"))


def running_lists(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Columns of array deltas replaced by all of the group's arrays up to the row, one after another."""
    w = _up_to_here(keys, order)
    return rows.select(*(F.flatten(F.collect_list(c).over(w)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest in order. A partial aggregate, so a hot key is reduced before the shuffle."""
    return _pick(rows, keys, order, F.max)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least in order."""
    return _pick(rows, keys, order, F.min)


def _pick(rows: DataFrame, keys: list[str], order: list[str], best) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    by = {"max": F.max_by, "min": F.min_by}["max" if best is F.max else "min"]
    place = F.struct(*order)
    return rows.groupBy(*keys).agg(by(F.struct(*rest), place).alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*rows.columns)


def latest_checkpoint(points: DataFrame, keys: list[str], offset: str, valid: Column) -> DataFrame:
    """The valid checkpoint of greatest offset of each group."""
    return last_wins(points.where(valid), keys, [offset])


def prefix_that_fits(rows: DataFrame, keys: list[str], order: list[Column], need: Column, capacity: Column) -> DataFrame:
    """The rows in order until the first that no longer fits; nothing after it is taken, however small."""
    rows = rows.withColumn("__need", F.sum(need).over(_up_to_here(keys, order)))
    return valid_prefix(rows, keys, order, F.col("__need") > capacity).drop("__need")


def group_starts(rows: DataFrame, keys: list[str], order: list[Column], group: str) -> DataFrame:
    """Adds `starts`: whether the row's group differs from the row before."""
    before = F.lag(group).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("starts", ~F.col(group).eqNullSafe(before) | before.isNull())


def walk_order(path: str = "path") -> Column:
    """Sort key of a lexical directory walk: by path component, not by the whole string."""
    return F.split(path, "/")


def tape_order(block: str = "block", path: str = "path") -> list[Column]:
    """Known start blocks first, ascending; the rest in walk order."""
    return [F.col(block).asc_nulls_last(), F.split(path, "/").asc()]


def deepest_first(path: str = "path") -> list[Column]:
    return [F.length(path).desc(), F.col(path).asc()]


def drive_order(path: str = "path") -> list[Column]:
    """Devices by the number at the end of their name, not by its digits: sg2 before sg10; names without one count as 0."""
    return [F.coalesce(F.regexp_extract(path, r"(\d+)\z", 1).try_cast("int"), F.lit(0)).asc(), F.col(path).asc()]
