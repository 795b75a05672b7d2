"""What an archiving run does with each source file: skip, refuse, refer to a copy, write, or stop when the tape is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.catalog import copies_with, copy_index
from archivolt.operators.ordered import first_wins, running_total, walk_order


def decide(
    files: DataFrame, here: DataFrame, written: DataFrame, catalog: DataFrame, tapes: DataFrame, tape_id: str, copies: int = 1, dedup: bool = True, least: int = 1
) -> DataFrame:
    """rel, source, size, sha256, decision, ref_tape, ref_path for files (source, rel, size, mtime_ns, sha256) in walk order.

    SKIP_HERE: this tape has rel with the same size and time. CONFLICT: with another. SKIP_ELSEWHERE: an own record of the source on another
    tape, and `copies` copies of its content, one that this run wrote before included. DUPLICATE: its content is on this tape,
    earlier in this run, or on an active tape while there are enough copies; only from `least` bytes on. Otherwise ARCHIVE.
    Sizes are matched before hashes. A file whose content differs from that of its record, though size and time are the same,
    follows what this run has written of either, in two steps.
    """
    order = walk_order("rel")
    mine = here.select(F.col("path").alias("rel"), F.col("size").alias("h_size"), F.col("mtime_ns").alias("h_mtime"))
    rows = files.join(mine, "rel", "left")
    at_place = F.when(F.col("h_size").isNull(), None).when((F.col("h_size") == F.col("size")) & (F.col("h_mtime") == F.col("mtime_ns")), "SKIP_HERE").otherwise("CONFLICT")
    records = written.where(F.col("tape_id") != tape_id).select("source", "size", "mtime_ns", F.col("sha256").alias("w_sha"), "tape_id", "line_no")
    before = first_wins(records, ["source", "size", "mtime_ns"], ["tape_id", "line_no"])
    rows = rows.join(before.select("source", "size", "mtime_ns", "w_sha"), ["source", "size", "mtime_ns"], "left")
    content = here.where("ref is null")
    index = copy_index(catalog.where(F.col("tape_id") != tape_id), tapes)  # this tape's content comes from the tape itself
    n = copies_with(index, content).withColumnRenamed("n", "n_copies")
    held = content.select("sha256").distinct().withColumn("held", F.lit(1))
    n = n.join(held, "sha256", "left")
    rows = rows.join(n.select(F.col("sha256").alias("w_sha"), F.col("n_copies").alias("w_copies"), F.col("held").alias("w_held")), "w_sha", "left")
    rows = rows.join(n.drop("held"), "sha256", "left")
    # candidates for a reference: this tape's content first, then others' in catalog order, if there are enough copies
    active = tapes.where("retired_ns is null").select(F.col("id").alias("tape_id"))
    others = catalog.where("ref is null").where(F.col("tape_id") != tape_id).join(active, "tape_id", "left_semi").select("sha256", "size", F.lit(1).alias("turn"), "tape_id", "path", "line_no")
    own = content.select("sha256", "size", F.lit(0).alias("turn"), F.lit(tape_id).alias("tape_id"), "path", "line_no")
    offers = own.unionByName(others).join(files.select("size").distinct(), "size", "left_semi")
    at = first_wins(offers, ["sha256", "turn"], ["tape_id", "line_no"])
    best = at.groupBy("sha256").agg(F.max(F.when(F.col("turn") == 0, F.struct("tape_id", "path"))).alias("o_here"), F.max(F.when(F.col("turn") == 1, F.struct("tape_id", "path"))).alias("o_other"))
    rows = rows.join(best, "sha256", "left").withColumn("place", F.struct(order.alias("o"), F.col("rel").alias("rel")))
    offer = F.coalesce("o_here", F.when(F.col("n_copies") >= copies, F.col("o_other")))
    may = F.lit(dedup) & (F.col("size") >= least)

    def first_written(rows: DataFrame, early: Column) -> DataFrame:
        """sha256, first: where the run first writes each content. A partial aggregate, so a content of very many files isn't sorted."""
        writes = early.isNull() & ~(may & offer.isNotNull())
        return rows.where(writes).groupBy("sha256").agg(F.min("place").alias("first"))

    found = F.when(F.col("w_copies") >= copies, "SKIP_ELSEWHERE")
    one = first_written(rows, F.coalesce(at_place, found)).select(F.col("sha256").alias("w_sha"), F.col("first").alias("w_first"))
    rows = rows.join(one, "w_sha", "left")
    wrote = F.col("w_held").isNull() & (F.col("w_first") < F.col("place"))
    early = F.coalesce(at_place, F.when(F.coalesce("w_copies", F.lit(0)) + F.coalesce(wrote.cast("int"), F.lit(0)) >= copies, F.when(F.col("w_sha").isNotNull(), "SKIP_ELSEWHERE")))
    rows = rows.withColumn("early", early)
    rows = rows.join(first_written(rows, F.col("early")), "sha256", "left")
    free = F.col("early").isNull() & may
    again = free & offer.isNull() & F.coalesce(F.col("first") < F.col("place"), F.lit(False))
    decision = F.coalesce("early", F.when((free & offer.isNotNull()) | again, "DUPLICATE"), F.lit("ARCHIVE"))
    return rows.select(
        "rel", "source", "size", "sha256", decision.alias("decision"),
        F.when(again, F.lit(tape_id)).when(free, offer["tape_id"]).alias("ref_tape"), F.when(again, F.col("first.rel")).when(free, offer["path"]).alias("ref_path"),
    )


def until_full(planned: DataFrame, need: Column, capacity: int) -> DataFrame:
    """planned with FULL for the first file to be written that doesn't fit, and STOPPED for all after it, whatever they are."""
    size = F.when(F.col("decision") == "ARCHIVE", need).otherwise(F.lit(0)).cast("long")
    rows = running_total(planned.withColumn("__need", size), [walk_order("rel"), F.col("rel")], F.col("__need"), "__so_far")
    first = (F.col("__so_far") - F.col("__need") <= capacity) & (F.col("__need") > 0)
    told = F.when(F.col("__so_far") <= capacity, F.col("decision")).when(first, "FULL").otherwise("STOPPED")
    return rows.withColumn("decision", told).drop("__need", "__so_far")


def collisions(files: DataFrame, suffix: str = ".age") -> DataFrame:
    """stored names that two different files would take: a plain one and an encrypted one. files: rel, encrypted."""
    stored = F.when(F.col("encrypted"), F.concat("rel", F.lit(suffix))).otherwise(F.col("rel"))
    return files.select(stored.alias("stored"), "rel").groupBy("stored").agg(F.countDistinct("rel").alias("files")).where("files > 1")


def summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("decision").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
