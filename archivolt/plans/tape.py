"""Planners about one mounted tape: unrecorded files, pending records, restores, its identity, the encryption gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.validate import valid_path
from archivolt.operators.catalog import find_tape, in_subtree, matching_tapes, other_copies, stored_view
from archivolt.operators.ordered import tape_order


def recover(listing: DataFrame, entries: DataFrame, meta_dir: str = ".archive", sums: str = "SHA256SUMS", partial: str = ".partial") -> DataFrame:
    """path, decision (ORPHAN or IGNORED) and reason of files on tape that no entry records, orphans in tape order.

    listing: path, regular, block (start block or null). The metadata folder and the checksum list are no files of the tape.
    """
    rows = listing.where(~in_subtree(F.col("path"), meta_dir) & ~F.col("path").isin(sums, f"{sums}.tmp"))
    rows = rows.join(stored_view(entries).select("path").distinct(), "path", "left_anti")
    names = entries.select("path").distinct().withColumn("taken", F.lit(True))
    rows = rows.join(names, "path", "left")
    reason = (
        F.when(F.col("taken"), "the name of an encrypted file on this tape")
        .when(F.col("path").endswith(partial), "incomplete transfer")
        .when(~F.col("regular"), "not a regular file")
        .when(~valid_path(F.col("path"), meta_dir, sums), "unsupported file name")
    )
    rows = rows.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "ORPHAN").otherwise("IGNORED"))
    return rows.orderBy(F.col("decision").desc(), *tape_order()).select("path", "block", "decision", "reason")


def flush(pending: DataFrame, entries: DataFrame, listing: DataFrame) -> DataFrame:
    """path, decision and reason for each pending entry (path, size, sha256, ref, age): RECORDED (on tape already, with the same
    content), CONFLICT (with another), ROLLED_BACK (its file isn't there as recorded), PARITY (recorded, parity added) or NEW."""
    done = entries.select("path", F.col("sha256").alias("on_tape"))
    rows = pending.join(done, "path", "left").withColumn("stored", F.when(F.col("age").isNotNull(), F.concat("path", F.lit(".age"))).otherwise(F.col("path")))
    real = listing.select(F.col("path").alias("stored"), F.col("size").alias("real"), "regular")
    rows = rows.join(real, "stored", "left")
    want = F.coalesce("age.size", "size")
    there = F.col("ref").isNotNull() | (F.coalesce("regular", F.lit(False)) & F.coalesce(F.col("real") == want, F.lit(False)))
    has_parity = F.col("parity_hashes").isNotNull() if "parity_hashes" in pending.columns else F.lit(False)
    decision = (
        F.when(F.col("on_tape").isNotNull() & (F.col("on_tape") != F.col("sha256")), "CONFLICT")
        .when(F.col("on_tape").isNotNull() & has_parity, "PARITY")
        .when(F.col("on_tape").isNotNull(), "RECORDED")
        .when(~there, "ROLLED_BACK")
        .otherwise("NEW")
    )
    return rows.select("path", "size", decision.alias("decision"))


def pending_totals(pending: DataFrame) -> DataFrame:
    """bytes stored of entries that aren't references, and parity bytes."""
    stored = F.when(F.col("ref").isNull(), F.coalesce("age.size", "size")).otherwise(0)
    return pending.agg(F.coalesce(F.sum(stored), F.lit(0)).alias("bytes"), F.coalesce(F.sum("parity_bytes"), F.lit(0)).alias("parity_bytes"))


def restore(entries: DataFrame, status: DataFrame, prefix: str = "", existing: DataFrame | None = None) -> DataFrame:
    """path, decision, other_tapes: REF (content is elsewhere), EXISTS (never overwritten), FAILED (with the tapes that
    hold the content too), REPAIR or RESTORE. entries: of all tapes with tape_id; status: tape_id, path, status of the tape read."""
    rows = other_copies(entries).join(status, ["tape_id", "path"]).where(in_subtree(F.col("path"), prefix))
    if existing is not None:
        rows = rows.join(existing.select("path", F.lit(True).alias("exists")), "path", "left")
    else:
        rows = rows.withColumn("exists", F.lit(False))
    decision = F.when(F.col("ref").isNotNull(), "REF").when(F.coalesce("exists", F.lit(False)), "EXISTS").when(F.col("status") == "failed", "FAILED").when(F.col("status") == "repairable", "REPAIR").otherwise("RESTORE")
    return rows.select("tape_id", "path", "size", decision.alias("decision"), F.when(decision.isin("REF", "FAILED"), F.col("other_tapes")).alias("other_tapes"))


def repair_volume(uuid: str | None, wanted: str | None, entries: DataFrame, tapes: DataFrame, catalog: DataFrame, intact: bool, has_records: bool) -> DataFrame:
    """One row: decision (REPAIR or REFUSE), reason, id of the cataloged tape a damaged or missing volume record belongs to."""
    spark = tapes.sparkSession
    refuse = lambda why: spark.createDataFrame([("REFUSE", why, None)], "decision string, reason string, id string")
    if intact:
        return refuse("the volume record is fine")
    if not has_records:
        return refuse("no records on this tape")
    chosen = spark.createDataFrame([(wanted,)], "id string") if wanted else find_tape(uuid, entries, tapes, catalog)
    row = spark.range(1).select(F.lit(1).alias("row"))
    one = row.join(chosen, F.lit(True), "left").join(tapes.select(F.col("id"), F.col("ltfs_uuid"), F.lit(True).alias("known")), "id", "left")
    same = matching_tapes(entries, catalog).select(F.col("tape_id").alias("id"), F.lit(True).alias("same"))
    readable = not entries.isEmpty()
    one = one.join(same, "id", "left").withColumn("readable", F.lit(readable))
    other = F.lit(uuid is not None) & F.col("ltfs_uuid").isNotNull() & (F.lower("ltfs_uuid") != F.lit((uuid or "").lower()))
    reason = (
        F.when(F.col("id").isNull(), "the tape could not be identified")
        .when(F.col("known").isNull(), "not in the catalog")
        .when(F.col("readable") & F.col("same").isNull(), "the files on this tape do not match")
        .when(~F.col("readable") & F.lit(wanted is None), "no readable records confirm its identity")
        .when(other, "the volume UUID differs")
    )
    return one.select(F.when(reason.isNull(), "REPAIR").otherwise("REFUSE").alias("decision"), reason.alias("reason"), "id")


def encryption_gate(tapes: DataFrame, drives: DataFrame) -> DataFrame:
    """id, decision, reason: whether a tape may be written with the drive as it is set. drives: id (of the loaded tape), encrypting, key.

    A tape once written encrypted is not written in the clear; a new key on such a tape, or a first one on a tape with files, is noted.
    """
    e = F.col("encryption")
    rows = tapes.join(drives, "id")
    was = e.isNotNull()
    decision = F.when(was & ~F.col("encrypting"), "REFUSE").when(F.col("encrypting") & was & ~F.array_contains(e["keys"], F.col("key")), "NOTE").when(F.col("encrypting") & ~was & (F.col("files") > 0), "NOTE").otherwise("ALLOW")
    reason = F.when(decision == "REFUSE", "the tape holds encrypted data but the drive does not encrypt").when((decision == "NOTE") & was, "another key than before").when(decision == "NOTE", "earlier files on this tape are not encrypted")
    return rows.select("id", decision.alias("decision"), reason.alias("reason"))


def pick_resume_point(points: DataFrame, keys: list[str], partial_size: Column, window: int) -> DataFrame:
    """The greatest checkpoint that the partial file still covers, at a window boundary, with a hash for each chunk before it."""
    chunks = F.size("chunks")
    ok = (F.col("offset") <= partial_size) & (F.col("offset") % window == 0) & F.col("state").isNotNull() & (chunks * F.col("chunk_size") == F.col("offset"))
    return points.where(ok).groupBy(*keys).agg(F.max_by(F.struct("offset", "state", "chunks"), "offset").alias("point")).select(*keys, "point.*")


def stale_state(journals: DataFrame, staged: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journals of files recorded meanwhile, staged parity without a journal), all by file_key."""
    return journals.join(recorded, "file_key", "left_semi"), staged.join(journals, "file_key", "left_anti")
