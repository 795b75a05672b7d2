"""Readers of a tape's metadata folder and of the local catalog, and of file trees."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import schemas
from archivolt.functions.scalars import file_key
from archivolt.functions.validate import chunks_problem, clean_label, entry_problem, parity_problem, pending_problem, valid_id, valid_path
from archivolt.operators.ordered import last_wins, running_lists, torn_tail, valid_prefix
from archivolt.operators.parity import parity_shards
from archivolt.sources.jsonl import epoch_ns, lines, parsed, read_lenient, read_strict

SEGMENT = r"/(\d{6})\.manifest\.jsonl$"


def _segment(pattern: str) -> Column:
    return F.regexp_extract("file", pattern, 1).try_cast("int")


def segments(spark: SparkSession, meta: str) -> DataFrame:
    """segment numbers of a tape, ascending: only those whose manifest exists, named by exactly six digits, from 1."""
    found = spark.read.format("binaryFile").load(f"{meta}/segments").select(F.col("path").alias("file"))
    return found.withColumn("segment", _segment(SEGMENT)).where("segment >= 1").select("segment").orderBy("segment")


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select("segment", "line_no", "path", F.coalesce("size", F.lit(0)).alias("size"), "sha256", epoch_ns(F.col("mtime")).alias("mtime_ns"), F.coalesce("source", F.lit("")).alias("source"), epoch_ns(F.col("archived_at")).alias("archived_at_ns"), "ref", F.coalesce("recovered", F.lit(False)).alias("recovered"), "age")


def entries(spark: SparkSession, meta: str) -> DataFrame:
    """A tape's entries in write order (segment, line_no); fails at the first bad line."""
    rows = read_strict(spark, f"{meta}/segments/*.manifest.jsonl", schemas.ENTRY_LINE, entry_problem())
    return _typed(rows.withColumn("segment", _segment(SEGMENT)).where("segment >= 1"))


def entries_lenient(spark: SparkSession, meta: str) -> tuple[DataFrame, DataFrame]:
    """(entries, problems): bad lines are counted, not fatal."""
    rows, bad = read_lenient(spark, f"{meta}/segments/*.manifest.jsonl", schemas.ENTRY_LINE, entry_problem())
    return _typed(rows.withColumn("segment", _segment(SEGMENT)).where("segment >= 1")), bad


def chunk_lists(spark: SparkSession, meta: str) -> tuple[DataFrame, DataFrame]:
    """(path, chunk_size, sha256; the last record of a path wins, problems)."""
    rows, bad = read_lenient(spark, f"{meta}/segments/*.chunks.jsonl", schemas.CHUNKS_LINE, chunks_problem())
    rows = rows.withColumn("segment", _segment(r"/(\d{6})\.chunks\.jsonl$"))
    return last_wins(rows.drop("file"), ["path"], ["segment", "line_no"]).drop("line_no"), bad


def parity_lists(spark: SparkSession, meta: str) -> tuple[DataFrame, DataFrame]:
    """(path, layout, offset, hashes, data_hashes, segment; the last record of a path wins, problems)."""
    rows, bad = read_lenient(spark, f"{meta}/segments/*.parity.jsonl", schemas.PARITY_LINE, parity_problem(parity_shards(F.col("layout"))))
    rows = rows.withColumn("segment", _segment(r"/(\d{6})\.parity\.jsonl$"))
    return last_wins(rows.drop("file"), ["path"], ["segment", "line_no"]).drop("line_no"), bad


def parity_by_segment(parity: DataFrame) -> DataFrame:
    """segment, records: its parity records by offset."""
    return parity.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("offset", "path", "layout", "hashes"))).alias("records"))


def optional(read, spark: SparkSession, *args):
    """read(spark, *args), or None where its files are missing."""
    try:
        return read(spark, *args)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def volume(spark: SparkSession, meta: str) -> DataFrame:
    """The tape's identity: its label cleaned, an ill-formed volume UUID dropped, UUIDs in lower case."""
    rows = spark.read.json(f"{meta}/volume.json", schema=schemas.VOLUME, multiLine=True)
    uuid = F.lower("ltfs_uuid")
    return rows.select("id", clean_label(F.col("label")).alias("label"), F.when(valid_id(uuid), uuid).alias("ltfs_uuid"), epoch_ns(F.col("created")).alias("created_ns")).where(valid_id(F.col("id")))


def has_records(found: DataFrame) -> bool:
    return not found.isEmpty()


def written_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(this machine's own records: tape_id from the file name, line_no and fields; problems)."""
    rows, bad = read_lenient(spark, f"{folder}/*.jsonl", schemas.ENTRY_LINE, entry_problem())
    return _with_tape(rows.withColumn("tape_id", F.regexp_extract("file", r"/([^/]+)\.jsonl$", 1))), bad


def _with_tape(rows: DataFrame) -> DataFrame:
    return rows.select("tape_id", "line_no", "path", F.coalesce("size", F.lit(0)).alias("size"), "sha256", epoch_ns(F.col("mtime")).alias("mtime_ns"), F.coalesce("source", F.lit("")).alias("source"), epoch_ns(F.col("archived_at")).alias("archived_at_ns"), "ref", F.coalesce("recovered", F.lit(False)).alias("recovered"), "age")


def pending_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records before a torn tail, state: torn, damaged_at). A bad line that isn't the last is damage: the caller must stop."""
    rows = parsed(lines(spark, path), schemas.PENDING_LINE, pending_problem())
    bad = F.col("problem").isNotNull()
    return valid_prefix(rows, ["file"], [F.col("line_no")], bad).drop("problem"), torn_tail(rows, ["file"], "line_no", bad)


def journal_log(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints of a journal up to its first bad record, with chunks and parity_hashes as all before and at each."""
    rows = parsed(lines(spark, path), schemas.JOURNAL_LINE, F.when(F.col("offset").isNull() | (F.col("offset") < 0), "invalid offset"))
    good = valid_prefix(rows, ["file"], [F.col("line_no")], F.col("problem").isNotNull()).drop("problem")
    good = good.withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>"))).withColumn("parity_hashes", F.coalesce("parity_hashes", F.array().cast("array<string>")))
    return running_lists(good, ["file"], [F.col("line_no")], ["chunks", "parity_hashes"])


def file_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Regular files below root: path, rel, size, mtime_ns, and content if wanted; without it the bytes aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    rel = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?" + "\\Q" + base + "\\E/", "")
    cols = ["path", rel.alias("rel"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")]
    return rows.select(*cols, *(["content"] if content else []))


def sources_checked(tree: DataFrame, suffixes: tuple[str, ...] = (".partial", ".age")) -> DataFrame:
    """tree with `refused`: why a source file can't be archived, else null."""
    reserved = F.lit(False)
    for s in suffixes:
        reserved = reserved | F.col("rel").endswith(s)
    return tree.withColumn("refused", F.when(F.col("rel").rlike("[\n\r]"), "unsupported file name").when(reserved, "reserved suffix").when(~valid_path(F.col("rel")), "unsupported file name"))


def with_file_key(rows: DataFrame, path: str = "path") -> DataFrame:
    return rows.withColumn("file_key", file_key(F.col(path)))
