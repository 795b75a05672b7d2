"""Shared helpers: written intermediate tables, bounded Arrow slices, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.shared import fresh_path

#: Bytes of text handled at once in a Python worker; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows handled at once, however short.
SLICE_ROWS = 4096
#: Rows and bytes up to which a small side is broadcast; beyond either the join is shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame) -> bool:
    """Whether a written table of plain columns has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    rows = df.count()  # from the footers
    if rows > BROADCAST_ROWS:
        return False
    size = 8 * rows * (len(df.columns) - len(wide))
    if wide and rows:
        size += df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in wide), F.lit(16 * len(wide))))).first()[0]
    return size <= BROADCAST_BYTES


def small_side(df: DataFrame) -> DataFrame:
    """A written table, marked to be broadcast if it is small."""
    return F.broadcast(df) if is_small(df) else df


def packed(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """(docs as one struct column `row`, so that no name can clash; the place of text_col in it). Texts go to Python once."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), docs.columns.index(text_col)


def fields_of(rows: pa.StructArray, places: list[int] | None) -> pa.StructArray:
    """rows with only the fields at some places, or as they are."""
    return rows if places is None else pa.StructArray.from_arrays([rows.field(i) for i in places], [rows.type[i].name for i in places])


def column_of(batch: pa.RecordBatch, column: str | int) -> pa.Array:
    """A batch's column by name, or a field of its `row` by place."""
    return batch.column("row").field(column) if isinstance(column, int) else batch.column(column)


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most SLICE_ROWS rows whose text adds up to at most limit bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(column_of(batch, column).cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, before + limit, side="right"))), start + SLICE_ROWS)
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str | int = "text") -> pa.Array:
    """A batch's text column as strings without nulls."""
    return pc.fill_null(column_of(batch, column).cast(pa.string()), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1] from 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


class Words:
    """Words (runs without ASCII white space) of many texts: code of each, per-text counts, dictionary."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(texts)
        encoded = parts.flatten().dictionary_encode()
        self.dictionary = encoded.dictionary
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        empty = pc.index(self.dictionary, "").as_py()
        if empty >= 0:  # white space at either end
            keep = codes != empty
            codes, doc = codes[keep], doc[keep]
        self.codes, self.doc = codes, doc
        self.counts = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word occurrence."""
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, self.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(self.dictionary))
        return known[self.codes] if len(known) else np.zeros(0, np.uint64)

    def lower_hashes(self) -> np.ndarray:
        """As hashes(), of words in lower case without outer ASCII punctuation; 0 for words of nothing else."""
        bare = [w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in self.dictionary.to_numpy(zero_copy_only=False).tolist()]
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in bare), np.uint64, len(bare))
        return known[self.codes] if len(known) else np.zeros(0, np.uint64)


def sums_by(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole sums of values for each of n texts."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit shingle) of every run of width words; a shorter text is one shingle of all its words."""
    starts = np.cumsum(counts) - counts
    number = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), number)
    at = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + np.repeat(starts, number)
    key = np.zeros(len(at), np.uint64)
    for j in range(width):
        key = key * np.uint64(0x100000001B3) + hashes[at + j]
    docs, keys = [doc], [mix64(key + GOLDEN)]
    for n in range(1, width):
        few = np.flatnonzero(counts == n)
        key = np.full(len(few), n, np.uint64)
        for j in range(n):
            key = key * np.uint64(0x100000001B3) + hashes[starts[few] + j]
        docs.append(few)
        keys.append(mix64(key))
    return np.concatenate(docs), np.concatenate(keys)


def distinct_counts(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) in order, and how often each occurs."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return doc[first], key[first], np.diff(np.append(first, len(doc)))


def text_key(column="text"):
    """16 bytes that identify a text (null as empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit(""))))
