"""Which source files are safely on verified tapes and may be deleted, and why the others are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions.scalars import tape_name
from archivolt.operators.catalog import last_verification, verified_since
from archivolt.operators.ordered import accepted_copies, last_wins


def records(files: DataFrame, written: DataFrame, entries: DataFrame, tapes: DataFrame, verifications: DataFrame) -> DataFrame:
    """A row per file and own record of its source, in record order (tape_id, line_no), with the content it leads to and
    `reason`: why it is no verified copy, else null.

    files: path, size, mtime_ns. written: this machine's log, which alone says where a source went. entries: all tapes' manifests,
    which say what is there; the last of a location wins. A reference is followed once.
    """
    place = last_wins(entries.select("tape_id", "path", "segment", "line_no", "sha256", "ref", "archived_at_ns"), ["tape_id", "path"], ["segment", "line_no"])
    known = tapes.join(last_verification(verifications).drop("v"), F.col("id") == F.col("tape_id"), "left").select("id", "retired_ns", "verified_ok", "verified_at_ns", tape_name(F.col("label"), F.col("id")).alias("name"))
    own = written.select(F.col("source"), F.col("tape_id").alias("w_tape"), F.col("path").alias("w_path"), "line_no", F.col("size").alias("w_size"), F.col("mtime_ns").alias("w_mtime"), F.col("sha256").alias("w_sha"))
    rows = files.select("path", "size", "mtime_ns").join(own, (F.col("path") == F.col("source")), "left")
    on = place.select(F.col("tape_id").alias("w_tape"), F.col("path").alias("w_path"), F.col("sha256").alias("m_sha"), "ref", F.col("archived_at_ns").alias("m_at"))
    rows = rows.join(on, ["w_tape", "w_path"], "left")
    target = place.select(F.col("tape_id").alias("t_tape"), F.col("path").alias("t_path"), F.col("sha256").alias("t_sha"), F.col("ref").alias("t_ref"), F.col("archived_at_ns").alias("t_at"), F.lit(True).alias("t_found"))
    rows = rows.join(target, (F.col("ref.tape") == F.col("t_tape")) & (F.col("ref.path") == F.col("t_path")), "left")
    is_ref = F.col("ref").isNotNull()
    rows = rows.withColumn("c_tape", F.when(is_ref, F.col("t_tape")).otherwise(F.col("w_tape"))).withColumn("c_at", F.when(is_ref, F.col("t_at")).otherwise(F.col("m_at")))
    rows = rows.join(known.select(F.col("id").alias("c_tape"), "retired_ns", "verified_ok", "verified_at_ns", "name"), "c_tape", "left")
    rows = rows.join(known.select(F.col("id").alias("w_tape"), F.col("name").alias("w_name")), "w_tape", "left")
    said = lambda name, text: F.concat(F.lit("tape "), name, F.lit(text))
    # The reasons, as far as they go here; a report may add sizes and times to "differs"
    reason = (
        F.when(F.col("w_tape").isNull(), "not archived")
        .when((F.col("w_size") != F.col("size")) | (F.col("w_mtime") != F.col("mtime_ns")), F.lit("archived copy differs"))
        .when(F.col("m_sha").isNull() | (F.col("m_sha") != F.col("w_sha")), said(F.coalesce("w_name", "w_tape"), " does not list this file"))
        .when(is_ref & (F.col("t_found").isNull() | F.col("t_ref").isNotNull() | (F.col("t_sha") != F.col("w_sha"))), F.lit("deduplicated copy not found in the catalog"))
        .when(F.col("retired_ns").isNotNull(), said(F.coalesce("name", "c_tape"), " is retired"))
        .when(~verified_since(F.col("verified_ok"), F.col("verified_at_ns"), F.col("c_at")), said(F.coalesce("name", "c_tape"), " has not passed verification since archiving"))
    )
    return rows.select("path", "size", "mtime_ns", "w_tape", "line_no", "w_sha", "c_tape", F.coalesce("name", "c_tape").alias("name"), reason.alias("reason"))


def plan(files: DataFrame, written: DataFrame, entries: DataFrame, tapes: DataFrame, verifications: DataFrame, copies: int = 1) -> DataFrame:
    """path, size, decision (DELETE or KEEP), reason (of KEEP), tapes (names of the copies found, sorted).

    Records are taken in order: the first verified copy fixes the content, each tape counts once, `copies` are enough.
    The reason of a file without any verified copy is the last one given, or that the copies differ.
    """
    rows = records(files, written, entries, tapes, verifications)
    order = [F.col("w_tape"), F.col("line_no")]
    got = accepted_copies(rows, ["path"], order, F.col("reason").isNull(), "w_sha", "c_tape", F.lit(copies))
    got = got.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("tapes"))
    differs = "archived copy differs"
    last = rows.groupBy("path", "size", "mtime_ns").agg(F.max_by(F.when(F.col("reason") != differs, F.col("reason")), F.when(F.col("reason") != differs, F.struct(F.coalesce("w_tape", F.lit("")), F.coalesce("line_no", F.lit(0))))).alias("last"))
    out = last.join(got, "path", "left")
    few = F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(f" of {copies} required verified copies ("), F.array_join("tapes", ", "), F.lit(")"))
    reason = F.when(F.col("n") >= copies, F.lit(None)).when(F.col("n") > 0, few).otherwise(F.coalesce("last", F.lit(differs)))
    return out.select("path", "size", "mtime_ns", F.when(F.col("n") >= copies, "DELETE").otherwise("KEEP").alias("decision"), reason.alias("reason"), F.coalesce("tapes", F.array().cast("array<string>")).alias("tapes"))


def rehashed(planned: DataFrame, contents: DataFrame, shas: DataFrame) -> DataFrame:
    """planned with files kept after all whose content no longer has the hash archived. contents: path, content; shas: path, sha256."""
    now = contents.select("path", F.sha2("content", 256).alias("now")).join(shas, "path")
    out = planned.join(now, "path", "left")
    gone = F.when(F.col("now").isNull(), "cannot reread").when(F.col("now") != F.col("sha256"), "content differs from the archived copy")
    stop = (F.col("decision") == "DELETE") & gone.isNotNull()
    return out.select("path", "size", "mtime_ns", F.when(stop, "KEEP").otherwise(F.col("decision")).alias("decision"), F.when(stop, gone).otherwise(F.col("reason")).alias("reason"), "tapes")


def totals(planned: DataFrame) -> DataFrame:
    """files and bytes to delete, files kept, and the distinct tapes that hold what goes."""
    gone = F.col("decision") == "DELETE"
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(gone, F.col("tapes"))))))
    return planned.agg(F.count_if(gone).alias("delete"), F.count_if(~gone).alias("keep"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("bytes"), names.alias("tapes"))


def recheck(planned: DataFrame, now: DataFrame) -> DataFrame:
    """Files still to be deleted: those whose size and time are what was planned."""
    return planned.where("decision = 'DELETE'").join(now.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_semi")


def emptied_folders(deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Folders above deleted files that hold none of the remaining ones, the deepest first."""

    def above(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        return df.where(F.size(parts) > 1).select(F.explode(ups).alias("folder")).where("folder <> ''").distinct()

    return above(deleted).join(above(remaining), "folder", "left_anti").orderBy(F.length("folder").desc(), "folder")
