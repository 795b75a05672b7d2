"""Files too large for one row, read piece by piece on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.content import CHUNK_SIZE
from archivolt.operators.parity import WINDOW, chunk_count, parity_shards, position_of, stripe_of, window_of

READ = "actual_size long, sum string, hashes array<string>, unreadable array<int>"


def read_pieces(path: str, chunk_size: int) -> tuple[int | None, str | None, list[str | None], list[int]]:
    """(size, SHA-256 of the whole, of each piece, pieces that can't be read); one piece is held at a time. A piece that can't be read
    leaves the others readable, but the whole without a hash. No size where there is no such file."""
    try:
        size = Path(path).stat().st_size
    except OSError:
        return None, None, [], []
    whole, hashes, lost = sha256(), [], []
    try:
        with Path(path).open("rb", buffering=0) as f:
            for i in range(-(-size // chunk_size)):
                try:
                    f.seek(i * chunk_size)
                    piece = _full(f, min(chunk_size, size - i * chunk_size))
                except OSError:
                    lost.append(i)
                    hashes.append(None)
                    continue
                whole.update(piece)
                hashes.append(sha256(piece).hexdigest())
    except OSError:
        return size, None, [None] * -(-size // chunk_size), list(range(-(-size // chunk_size)))
    return size, None if lost else whole.hexdigest(), hashes, lost


def _full(f, size: int) -> bytes:
    """size bytes, by as many reads as it takes; fewer at the end of the file."""
    parts = []
    while size and (part := f.read(size)):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def hash_files(files: DataFrame, path: str = "path", chunk_size: Column | int = CHUNK_SIZE) -> DataFrame:
    """files with actual_size, sum, hashes and unreadable of what lies at path, a path every executor sees. A file is read once, in order."""
    cs = F.lit(chunk_size) if isinstance(chunk_size, int) else chunk_size
    rows = files.select(F.struct(*files.columns).alias("row"), F.col(path).alias("at"), F.coalesce(cs, F.lit(CHUNK_SIZE)).cast("long").alias("cs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, whole, hashes, lost = read_pieces(batch.column("at")[i].as_py() or "", batch.column("cs")[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), pa.array([size], pa.int64()), pa.array([whole], pa.string()), pa.array([hashes], pa.list_(pa.string())), pa.array([lost], pa.list_(pa.int32()))], ["row", "actual_size", "sum", "hashes", "unreadable"])

    found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {READ}")
    return found.select("row.*", "actual_size", "sum", "hashes", "unreadable")


def scan_files(entries: DataFrame, path: str = "stored_path") -> DataFrame:
    """As content.scan(), of files of any size: entries (size, sha256, chunk_size and chunk_sha256, null if unknown) with their place.

    Adds actual_size, sum, bad, unreadable and tail. A chunk size outside the bounds of valid records is refused before.
    """
    cs = F.coalesce("chunk_size", F.lit(CHUNK_SIZE)).cast("long")
    rows = hash_files(entries, path, cs)
    n = F.ceil(F.least("actual_size", "size") / cs).cast("int")
    whole = F.when(F.col("actual_size") < F.col("size"), F.floor(F.col("actual_size") / cs)).otherwise(n).cast("int")
    at = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    differs = lambda i: F.array_contains("unreadable", i) | F.coalesce(F.get("hashes", i) != F.get("chunk_sha256", i), F.lit(False))
    tail = F.when(F.col("actual_size") < F.col("size"), F.floor(F.col("actual_size") / cs))
    return rows.select(*entries.columns, "actual_size", "sum", F.filter(at, differs).alias("bad"), "unreadable", tail.alias("tail"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            path, at, size = (batch.column(c)[i].as_py() for c in ("path", "at", "size"))
            raw = None
            try:
                with Path(path).open("rb", buffering=0) as f:
                    f.seek(at)
                    raw = _full(f, size)
            except OSError:
                pass  # a shard that can't be read is a lost one
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), pa.array([raw], pa.binary())], ["row", "shard"])


def data_shards(scanned: DataFrame, keys: list[str], path: str = "stored_path") -> DataFrame:
    """What parity.repair() needs, read from damaged files: the data shards of stripes with a bad or missing chunk, and no others.

    scanned: of scan_files(), with a window layout, whose shards are the chunks; small files are taken whole by
    parity.split_chunks(). A file longer than recorded, or cut by more chunks than it has parity shards, gives none, so a forged
    size makes no long list. Each row holds one shard.
    """
    x = F.col("layout")
    count = chunk_count(x).cast("int")
    missing = F.coalesce(count - F.col("tail"), F.lit(0))
    rows = scanned.where((x["scheme"] == WINDOW) & ((F.size("bad") > 0) | F.col("tail").isNotNull()) & (F.col("actual_size") <= F.col("size")) & (missing <= parity_shards(x)))
    rows = rows.select(*keys, F.col(path).alias("__file"), "layout", "bad", "tail", "chunk_sha256", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    lost = F.array_contains("bad", F.col("chunk")) | F.coalesce(F.col("chunk") >= F.col("tail"), F.lit(False))
    place = [f(x, F.col("chunk")).cast("long").alias(n) for n, f in (("window", window_of), ("stripe", stripe_of), ("pos", position_of))]
    rows = rows.select(*keys, "__file", "layout", F.col("chunk").cast("long").alias("chunk"), *place, F.get("chunk_sha256", F.col("chunk")).alias("wanted"), lost.alias("lost"))
    rows = rows.join(rows.where("lost").select(*keys, "window", "stripe").distinct(), [*keys, "window", "stripe"], "left_semi")
    ranges = rows.select(F.struct(*(c for c in rows.columns if c != "__file")).alias("row"), F.when(~F.col("lost"), F.col("__file")).otherwise("").alias("path"), (F.col("chunk") * x["shard_size"]).alias("at"), x["shard_size"].cast("long").alias("size"))
    return ranges.mapInArrow(_ranges, f"row {ranges.schema['row'].dataType.simpleString()}, shard binary").select("row.*", "shard").drop("lost")
