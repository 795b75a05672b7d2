"""Sinks: record lines, checksum lists, segments and catalog tables, each committed as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.operators.catalog import is_content, stored_view
from archivolt.sources.jsonl import encode


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON line per row. The committer publishes all part files or none."""
    encode(rows).write.mode(mode).text(path)


def checksum_lines(entries: DataFrame) -> DataFrame:
    """The checksum list: 'hash  path' of what lies on tape, in write order; references aren't listed."""
    rows = stored_view(entries.where(is_content()))
    return rows.orderBy("segment", "line_no").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def checksum_digest(lines: DataFrame) -> DataFrame:
    """One row: rows and an order-free digest, to see whether a written list is stale without rewriting it."""
    return lines.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def ensure_checksums(entries: DataFrame, path: str) -> bool:
    """Write the list if the one at path is missing or stale; whether it did."""
    spark = entries.sparkSession
    new = checksum_lines(entries)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        if checksum_digest(spark.read.text(path)).first() == checksum_digest(new).first():
            return False
    new.coalesce(1).write.mode("overwrite").text(path)
    return True


def write_segment(manifest: DataFrame, chunks: DataFrame, parity: DataFrame, root: str, segment: int) -> None:
    """A segment's lists, the manifest last: a segment exists if and only if its manifest does, so leftovers of a broken run are overwritten."""
    base = f"{root}/segment={segment:06d}"
    write_lines(chunks, f"{base}/chunks", "overwrite")
    write_lines(parity, f"{base}/parity", "overwrite")
    write_lines(manifest, f"{base}/manifest", "errorifexists")


def add_parity(parity: DataFrame, root: str, segment: int) -> None:
    """Parity for a segment that has none; fails if it has."""
    write_lines(parity, f"{root}/segment={segment:06d}/parity", "errorifexists")


def append_written(rows: DataFrame, path: str) -> None:
    """This machine's own log. Each append is files of its own, so there are no torn tails."""
    rows.write.mode("append").partitionBy("tape_id").parquet(path)


def replace_tape(entries: DataFrame, path: str) -> None:
    """Overwrite the cataloged manifests of the tapes in entries, and no others."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tape_id").parquet(path)


def _restored(batches):
    import os
    from hashlib import sha256
    from pathlib import Path

    import pandas as pd

    for rows in batches:
        out = []
        for path, target, raw, want in zip(rows["path"], rows["target"], rows["content"], rows["sha256"]):
            place = Path(target)
            if sha256(raw).hexdigest() != want:
                out.append((path, "FAILED"))
                continue
            place.parent.mkdir(parents=True, exist_ok=True)
            partial = place.with_name(f".{place.name}.{os.getpid()}.partial")
            partial.write_bytes(raw)
            try:
                os.link(partial, place)  # fails if something is there: nothing is ever overwritten
                out.append((path, "RESTORED"))
            except FileExistsError:
                out.append((path, "EXISTS"))
            finally:
                partial.unlink()
        yield pd.DataFrame(out, columns=["path", "result"])


def restore_files(files: DataFrame, folder: str) -> DataFrame:
    """path, result of writing files (path, content, sha256) below a folder that all executors share: checked before they
    are published, published as a whole, never over what is there. A retried task finds its own file and says EXISTS."""
    rows = files.select("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path").alias("target"), "content", "sha256")
    return rows.mapInPandas(_restored, "path string, result string")


def new_volume(label: str, ltfs_uuid: str | None, now_ns: int, spark) -> DataFrame:
    """The identity of a tape that has none: a new UUID, the label cleaned."""
    from archivolt.functions.validate import clean_label

    one = spark.createDataFrame([(label, ltfs_uuid, now_ns)], "label string, ltfs_uuid string, created_ns long")
    return one.select(F.expr("uuid()").alias("id"), clean_label(F.col("label")).alias("label"), F.lower("ltfs_uuid").alias("ltfs_uuid"), "created_ns")
