"""Token ids of documents as ORC: run-length encoded integers in stripes, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.llm.common import GOLDEN, fresh_path, mix64, slices, small_side, texts_of, written


@dataclass(frozen=True)
class OrcTokens:
    """tokenizer: path of a tokenizers file on every machine; end_id: put after each document.

    file_bytes: text aimed at in a file, more where there would be over most_files; stripe_bytes, row_stride: of ORC stripes and of the row index; false_positives: of the Bloom filter.
    known_units: pieces of text whose ids a worker remembers, some 70 bytes each. slice_bytes: text encoded at once.
    batch_rows: rows of ids handed on at once. group: files whose tokens are added up together.
    """

    tokenizer: str
    end_id: int = 0
    file_bytes: int = 32 << 20
    most_files: int = 100_000
    stripe_bytes: int = 8 << 20
    row_stride: int = 1000
    false_positives: float = 0.01
    known_units: int = 1_000_000
    slice_bytes: int = 4 << 20
    batch_rows: int = 1024
    group: int = 1000


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Fixed: the characters with the White_Space property, at which the tokenizer's own pattern cuts, as UTF-8.
SPACES = [c.encode() for c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_ASCII_SPACE = np.isin(np.arange(256), [c[0] for c in SPACES if len(c) == 1])
_WIDE_LEAD = np.isin(np.arange(256), [c[0] for c in SPACES if len(c) > 1])


def space_mask(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    mask = _ASCII_SPACE[raw]
    lead = np.flatnonzero(_WIDE_LEAD[raw])
    for c in SPACES if len(lead) else ():
        if len(c) > 1:
            at = lead[lead + len(c) <= len(raw)]
            for j, byte in enumerate(c):
                at = at[raw[at + j] == byte]
            for j in range(len(c)):
                mask[at + j] = True
    return mask


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units of all texts, their number per text): runs of white space with the run of other signs after it; at the start of a
    text the white space may be missing, at its end the other signs. The string data isn't copied."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, last = int(bounds[0]), int(bounds[-1])
    if last == first:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    mask = space_mask(np.frombuffer(data, np.uint8)[first:last])
    cut = np.zeros(len(mask), bool)
    cut[1:] = mask[1:] & ~mask[:-1]
    cut[bounds[:-1][bounds[1:] > bounds[:-1]] - first] = True
    starts = np.flatnonzero(cut)
    per_text = np.diff(np.searchsorted(starts, bounds - first))
    ends = np.append(starts, len(mask)).astype(np.int32) + np.int32(first)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), data), per_text


class Column:
    """An array that grows at its end."""

    def __init__(self, kind, values=()):
        self.data, self.n = np.zeros(1 << 12, kind), 0
        self.append(np.asarray(values, kind))

    def append(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(end + (end >> 2) - self.n, self.data.dtype)])
        self.data[self.n : end] = values
        self.n = end

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.n]


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .. of each run, one run after the other."""
    return np.arange(int(size.sum()), dtype=np.int32) + np.repeat((first - (np.cumsum(size) - size)).astype(np.int32), size)


#: A 64-bit value for each byte, and for each place of a byte in a unit (repeated in longer ones).
_BYTE, _PLACE = (mix64(np.arange(1, n + 1).astype(np.uint64) * GOLDEN) | np.uint64(1) for n in (256, 1 << 12))


def spell_hashes(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits for each unit raw[bounds[i]:bounds[i + 1]], none of them empty."""
    size = np.diff(bounds)
    place = np.arange(len(raw)) - np.repeat(bounds[:-1], size)
    return mix64(np.add.reduceat(_BYTE[raw] * _PLACE[place & (len(_PLACE) - 1)], bounds[:-1]) + size.astype(np.uint64))


class Encoder:
    """Encodes texts by the tokenizers library, each distinct unit once as long as it is remembered.

    The byte-level pattern never takes a sign and a white space after it into one piece, and looks ahead only within
    white space, so the ids of a text are those of its units in a row. Special strings hold no white space, so they
    lie in one unit too. For the same reason many units that begin with white space and end in another sign are encoded
    as one text, and the ids dealt back by their bytes, of which every id has a fixed number. Units of white space alone
    are not: the pattern would take them together with the white space of the next unit.

    Units are remembered as bytes in one array, found by a 64-bit hash and then compared byte by byte, so a clash of
    hashes costs time and no wrong id. Number 0 is the end of a text.
    """

    def __init__(self, path: str, room: int, end_id: int = 0):
        self.tokenizer, self.room = tokenizer(path), room
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = np.fromiter(((len(self.tokenizer.id_to_token(i)) if self.tokenizer.id_to_token(i) else 0) for i in range(size)), np.int64, size)
        self.keys, self.of_key = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.spelt = Column(np.int32, [end_id]), Column(np.uint8)
        self.first, self.size, self.hits = Column(np.int32, [0]), Column(np.int32, [1]), Column(np.int32, [0])
        self.at, self.long = Column(np.int32, [0]), Column(np.int32, [0])  # of the spelling

    def forget(self) -> None:
        """Make room: keep the units that most slices had since the last time, half of the room at most."""
        hits = self.hits.all[1:]
        least = max(2, int(np.partition(hits, -(self.room // 2))[-(self.room // 2)]) + 1 if len(hits) > self.room // 2 else 2)
        keep = np.concatenate([[0], np.flatnonzero(hits >= least) + 1])
        number = np.full(self.size.n, -1, np.int32)
        number[keep] = np.arange(len(keep))
        known = number[self.of_key] >= 0
        self.keys, self.of_key = self.keys[known], number[self.of_key[known]]
        for values, first, size in (("ids", "first", "size"), ("spelt", "at", "long")):
            a, n = getattr(self, first).all[keep], getattr(self, size).all[keep]
            moved = Column(getattr(self, values).data.dtype, getattr(self, values).data[runs(a, n)])
            setattr(self, values, moved)
            setattr(self, first, Column(np.int32, np.cumsum(n) - n))
            setattr(self, size, Column(np.int32, n))
        self.hits = Column(np.int32, np.zeros(len(keep)))

    def numbers(self, names: pa.Array) -> np.ndarray:
        """The number of each of some distinct units; new ones are encoded and remembered."""
        if not len(names):
            return np.zeros(0, np.int32)
        _, offsets, data = names.buffers()
        bounds = np.frombuffer(offsets, np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        size, key = np.diff(bounds), spell_hashes(raw, bounds)
        order = np.argsort(key)
        place = np.searchsorted(self.keys, key[order])
        hit = place < len(self.keys)
        hit[hit] = self.keys[place[hit]] == key[order][hit]
        number = np.full(len(names), -1, np.int32)
        number[order[hit]] = self.of_key[place[hit]]
        some = np.flatnonzero(number >= 0)
        some = some[self.long.data[number[some]] == size[some]]
        known = np.zeros(len(names), bool)
        if len(some):
            differs = raw[runs(bounds[some], size[some])] != self.spelt.data[runs(self.at.data[number[some]], size[some])]
            known[some] = ~np.logical_or.reduceat(differs, np.cumsum(size[some]) - size[some])
        new = np.flatnonzero(~known)
        if len(new):
            mask = space_mask(raw)
            joined = mask[bounds[new]] & ~mask[bounds[new + 1] - 1]  # a unit that ends in white space holds nothing else
            for which, encoded in ((new[joined], self.together), (new[~joined], self.apart)):
                if len(which):
                    number[which] = self.size.n + np.arange(len(which))
                    ids, n = encoded(raw[runs(bounds[which], size[which])], size[which])
                    for values, first, counts, found, many in ((self.ids, self.first, self.size, ids, n), (self.spelt, self.at, self.long, raw[runs(bounds[which], size[which])], size[which])):
                        first.append(values.n + np.cumsum(many) - many)
                        counts.append(many)
                        values.append(found)
                    self.hits.append(np.zeros(len(which)))
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.of_key = keys[order], np.concatenate([self.of_key, number[new]])[order]
        self.hits.data[number] += 1
        return number

    def together(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each unit) of units that may stand in a row."""
        ends = np.cumsum(size)
        stops = ends[np.minimum(np.arange(511, len(size) + 511, 512), len(size) - 1)]
        blocks = [raw[a:b].tobytes().decode() for a, b in zip(np.concatenate([[0], stops[:-1]]), stops)]
        found = self.tokenizer.encode_batch_fast(blocks, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        last = np.searchsorted(np.cumsum(self.width[ids]), ends, side="right")
        return ids, np.diff(last, prepend=0)

    def apart(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As together(), each unit by itself: it doesn't begin with white space or is nothing else."""
        ends = np.cumsum(size)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[b - n : b].tobytes().decode() for b, n in zip(ends, size)], add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(n.sum())), n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, their number per text)."""
        parts, per_text = units(texts)
        encoded = parts.dictionary_encode()
        if self.size.n + len(encoded.dictionary) > self.room and self.size.n > self.room // 2 + 1:
            self.forget()
        code = self.numbers(encoded.dictionary)[encoded.indices.to_numpy(zero_copy_only=False)] if len(parts) else np.zeros(0, np.int32)
        code = np.insert(code, np.cumsum(per_text), 0)
        size = self.size.data[code]
        n = np.add.reduceat(size, np.cumsum(per_text + 1) - per_text - 1, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        return self.ids.data[runs(self.first.data[code], size)], n


@cache
def encoder(path: str, room: int, end_id: int) -> Encoder:
    """One for all tasks of a Python worker, so units that a task has met are known to the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path, room, end_id)


def _tokenised(p: OrcTokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = encoder(p.tokenizer, p.known_units, p.end_id), 0
        for batch in batches:
            for part in slices(batch, "text", p.slice_bytes):
                ids, n = known.encode(texts_of(part))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                place = pa.array(np.arange(at, at + part.num_rows))
                at += part.num_rows
                for lo in range(0, part.num_rows, p.batch_rows):  # rows of ids are long, and a batch is held on both sides
                    some = ends[lo : lo + p.batch_rows + 1]
                    lists = pa.ListArray.from_arrays(pa.array(some - some[0]), pa.array(ids[some[0] : some[-1]]))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(lo, len(lists)), place.slice(lo, len(lists)), lists], ["doc_id", "place", "ids"])

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("place"), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["file", "doc_id", "place", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, p: OrcTokens, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (file, doc_id, place, ids) as ORC files under path, in ascending doc_id order over the files and within each.

    Files hold ranges of doc_id and are numbered in their order, so a filter on doc_id skips whole files, stripes and row
    groups by their statistics and Bloom filters, and stripes can be read apart. place numbers a file's rows. Null ids come
    first; null and empty texts are the end id alone; repeated ids stay together, by their text. Texts are taken whole; other
    columns are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = min(max(1, -(-int(total) // p.file_bytes)), p.most_files)
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_tokenised(p), "doc_id long, place long, ids array<int>")
    options = {
        "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(p.false_positives), "orc.row.index.stride": str(p.row_stride),
        "orc.stripe.size": str(p.stripe_bytes), "orc.rows.between.memory.checks": str(p.row_stride), "orc.create.index": "true",
    }
    encoded.select(F.spark_partition_id().alias("file"), "*").write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, place, ids) of what write_tokens() wrote; filters on doc_id are pushed down to stripes."""
    return spark.read.schema("file int, doc_id long, place long, ids array<int>").orc(path)


def token_table(spark: SparkSession, path: str, group: int = OrcTokens.group) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (little-endian 32-bit ids).

    Starts add up in three steps: groups of files (a number each), files of a group, rows of a file.
    """
    rows = written(read_tokens(spark, path).mapInArrow(_digested, "file int, doc_id long, place long, n_tokens long, ids_crc32 long"), "digests")
    files = written(rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("file") / group)), "files")

    def before(*keys: str, by: str):
        order = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")

    groups = files.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(by="group"))
    files = files.select("group", "file", before("group", by="file")).join(F.broadcast(groups.withColumnRenamed("before", "earlier")), "group")
    files = written(files.select("file", (F.col("before") + F.col("earlier")).alias("before")), "starts")
    within = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(small_side(files), "file")
    return rows.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(docs: DataFrame, p: OrcTokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token_table() of docs, written to fresh files in the shared folder and read back. An empty table gives no rows."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, p, id_col, text_col)
    return token_table(spark, path, p.group)
