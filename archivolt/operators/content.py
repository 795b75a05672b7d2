"""Content: chunk hashes, scans against recorded hashes, damage, verification status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.ordered import bad_ranges

#: Fixed value: bytes of a chunk unless the record names another.
CHUNK_SIZE = 4 << 20


def chunk_hashes(files: DataFrame, keys: list[str], content: str, chunk_size: Column | int) -> DataFrame:
    """keys, chunk (from 0), sha256 of each piece of content; an empty content has none.

    The number of pieces follows from the real length, never from a recorded one.
    """
    cs = F.lit(chunk_size).cast("int") if isinstance(chunk_size, int) else chunk_size.cast("int")
    data = F.col(content)
    n = F.ceil(F.octet_length(data) / cs).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = files.select(*keys, data.alias("data"), cs.alias("cs"), F.explode(at).alias("chunk"))
    return rows.select(*keys, "chunk", F.sha2(F.substring(F.col("data"), F.col("chunk") * F.col("cs") + 1, F.col("cs")), 256).alias("sha256"))


def whole_hash(content: str) -> Column:
    return F.sha2(F.col(content), 256)


def with_records(entries: DataFrame, chunks: DataFrame, parity: DataFrame, keys: list[str]) -> DataFrame:
    """entries (as stored) with their chunk list and parity where there are; parity only if its size is the stored one."""
    out = entries.join(chunks.select(*keys, "chunk_size", F.col("sha256").alias("chunk_sha256")), keys, "left")
    par = parity.select(*keys, "layout", "hashes")
    joined = out.join(par, keys, "left")
    fits = F.col("layout.size") == F.col("size")
    return joined.withColumn("hashes", F.when(fits, F.col("hashes"))).withColumn("layout", F.when(fits, F.col("layout")))


def scan(entries: DataFrame, files: DataFrame, keys: list[str], content: str = "content", read_errors: str | None = None) -> DataFrame:
    """Per entry what reading it back finds: actual_size, sum, bad (chunk indexes, array), unreadable, tail.

    entries: keys, size, sha256, chunk_size and chunk_sha256 (null if unknown). files: keys, content and, if named, an array of
    chunk indexes that can't be read. bad: chunks within the file that are unreadable or differ from their hash. tail: the
    first chunk of a missing end, or null; one number, so a forged size can't make a long list.
    """
    cs = F.coalesce("chunk_size", F.lit(CHUNK_SIZE)).cast("long")
    errors = F.col(read_errors) if read_errors else F.array().cast("array<int>")
    rows = entries.join(files.select(*keys, F.col(content).alias("data"), errors.alias("unreadable")), keys, "left").withColumn("cs", cs)
    real = F.octet_length("data").cast("long")
    n = F.ceil(F.least(real, F.col("size")) / F.col("cs")).cast("int")
    readable = F.when(real < F.col("size"), F.floor(real / F.col("cs"))).otherwise(n).cast("int")
    at = F.when(readable > 0, F.sequence(F.lit(0), readable - 1)).otherwise(F.array().cast("array<int>"))

    def differs(i: Column) -> Column:
        got = F.sha2(F.substring(F.col("data"), (i * F.col("cs") + 1).cast("int"), F.col("cs").cast("int")), 256)
        want = F.get("chunk_sha256", i)
        return F.coalesce(F.array_contains("unreadable", i), F.lit(False)) | F.coalesce(got != want, F.lit(False))

    tail = F.when(real < F.col("size"), F.floor(real / F.col("cs")))
    return rows.select(
        *entries.columns, real.alias("actual_size"), F.sha2("data", 256).alias("sum"), F.filter(at, differs).alias("bad"),
        F.coalesce("unreadable", F.array().cast("array<int>")).alias("unreadable"), tail.alias("tail"),
    )


def is_intact() -> Column:
    """Whether a scanned entry has no damage and the recorded hash."""
    return (F.size("unreadable") == 0) & (F.size("bad") == 0) & F.col("tail").isNull() & F.coalesce(F.col("sum") == F.col("sha256"), F.lit(False))


def describe_damage(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """scanned with `detail`: unreadable and damaged byte ranges and a missing end, else a hash mismatch; null if intact."""
    cs = F.coalesce("chunk_size", F.lit(CHUNK_SIZE)).cast("long")

    def told(list_: Column, name: str) -> DataFrame:
        rows = scanned.select(*keys, F.explode(list_).alias("i"), cs.alias("cs"), "size")
        return bad_ranges(rows, keys, "i", F.col("cs"), F.col("size")).withColumnRenamed("ranges", name)

    out = scanned.join(told(F.col("unreadable"), "r1"), keys, "left").join(told(F.array_except("bad", "unreadable"), "r2"), keys, "left")
    parts = F.array_compact(F.array(
        F.concat(F.lit("unreadable bytes: "), "r1"), F.concat(F.lit("damaged bytes: "), "r2"),
        F.when(F.col("tail").isNotNull(), F.concat(F.lit("file is cut short, bytes "), (F.col("tail") * cs).cast("string"), F.lit("-"), (F.col("size") - 1).cast("string"), F.lit(" missing"))),
    ))
    mismatch = F.concat(F.lit("SHA-256 mismatch: manifest "), "sha256", F.lit(", tape "), F.coalesce("sum", F.lit("")))
    detail = F.when(is_intact(), F.lit(None)).when(F.size(parts) > 0, F.concat_ws("; ", parts)).otherwise(mismatch)
    return out.withColumn("detail", detail).drop("r1", "r2")


def verify_status(repairable: Column) -> Column:
    """OK, repairable or failed of a scanned entry; a file larger than recorded, or missing, has failed."""
    grown = F.col("actual_size") > F.col("size")
    return F.when(F.col("actual_size").isNull() | grown, "failed").when(is_intact(), "OK").when(F.coalesce(repairable, F.lit(False)), "repairable").otherwise("failed")


def verify_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, files (references too), refs, verified, repairable, failed, bytes (original size of what is OK)."""
    is_ref = F.col("ref").isNotNull()
    of = lambda s: F.count_if(~is_ref & (F.col("status") == s))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("files"), F.count_if(is_ref).alias("refs"), of("OK").alias("verified"), of("repairable").alias("repairable"), of("failed").alias("failed"),
        F.coalesce(F.sum(F.when(~is_ref & (F.col("status") == "OK"), F.col("size"))), F.lit(0)).alias("bytes"),
    )


def damaged_parity(shards: DataFrame, keys: list[str]) -> DataFrame:
    """keys, damaged, shards, told: parity shards (hash wanted, got; got null if unreadable) that don't match."""
    bad = ~F.coalesce(F.col("got") == F.col("wanted"), F.lit(False))
    out = shards.groupBy(*keys).agg(F.count_if(bad).alias("damaged"), F.count("*").alias("shards"))
    return out.withColumn("told", F.when(F.col("damaged") > 0, F.format_string("%d of %d pieces damaged", "damaged", "shards")))


def recovered_entries(files: DataFrame, chunk_size: int = CHUNK_SIZE) -> tuple[DataFrame, DataFrame]:
    """(entries with recovered = true, chunk lists) of unrecorded files (tape_id, path, mtime_ns, content)."""
    entries = files.select("tape_id", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "mtime_ns", F.lit(True).alias("recovered"))
    parts = chunk_hashes(files, ["tape_id", "path"], "content", chunk_size)
    lists = parts.groupBy("tape_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda c: c["sha256"]).alias("sha256"))
    return entries, lists.withColumn("chunk_size", F.lit(chunk_size).cast("long"))
