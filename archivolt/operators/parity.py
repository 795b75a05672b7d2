"""Interleaved Reed-Solomon parity: geometry as column expressions, coding as Arrow group functions per stripe."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Data shards of a stripe, stripes of a window, most percent, names of the schemes, bounds of untrusted layouts.
K = 20
D = 16
MAX_PERCENT = 25
WINDOW, SMALL = "rs-window", "rs-small"
MAX_K, MAX_M, MAX_D = 32, 8, 64
MAX_SHARD, MAX_SIZE = 16 << 20, 1 << 50
#: Fixed value: the field polynomial.
POLYNOMIAL = 0x11D


# Geometry


def shards_for(percent: Column) -> Column:
    """Parity shards of a stripe for an overhead in percent: 20 * percent / 100, rounded up; null outside 0 .. 25."""
    return F.when((percent >= 0) & (percent <= MAX_PERCENT), F.ceil(percent * K / 100).cast("int"))


def layout(size: Column, chunk_size: Column, m: Column) -> Column:
    """A file's layout struct, null if it gets no parity: windows of stripes from 20 chunks on, else one small stripe."""
    large = size >= chunk_size * K
    shard = F.when(large, chunk_size).otherwise(F.ceil(size / K)).cast("long")
    made = F.struct(
        F.when(large, WINDOW).otherwise(SMALL).alias("scheme"), F.lit(K).alias("k"), m.cast("int").alias("m"), F.when(large, D).otherwise(0).alias("d"),
        shard.alias("shard_size"), size.cast("long").alias("size"),
    )
    return F.when((m > 0) & (size > 0), made)


def layout_problem(x: Column) -> Column:
    """Why an untrusted layout is refused, else null."""
    return (
        F.when(~x["scheme"].isin(WINDOW, SMALL) | x["scheme"].isNull(), "unknown parity scheme")
        .when(~(x["k"].between(1, MAX_K) & x["m"].between(1, MAX_M)), "parity shard counts out of range")
        .when(~(x["size"].between(1, MAX_SIZE) & x["shard_size"].between(1, MAX_SHARD)), "parity sizes out of range")
        .when((x["scheme"] == WINDOW) & ~(x["d"].between(1, MAX_D) & (x["size"] >= x["k"] * x["shard_size"])), "window parity parameters out of range")
        .when((x["scheme"] == SMALL) & ((x["d"] != 0) | (F.ceil(x["size"] / x["k"]) != x["shard_size"])), "small file parity parameters out of range")
    )


def chunk_count(x: Column) -> Column:
    return F.ceil(x["size"] / x["shard_size"]).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def window_of(x: Column, chunk: Column) -> Column:
    return _div(chunk, x["k"] * x["d"])


def window_stripes(x: Column, window: Column) -> Column:
    """Stripes of a window: fewer than d only in a short last window."""
    per = (x["k"] * x["d"]).cast("long")
    count = F.least(per, chunk_count(x) - window * per)
    return F.least(_div(count + x["k"] - 1, x["k"]), x["d"].cast("long"))


def stripe_of(x: Column, chunk: Column) -> Column:
    """Neighbouring chunks lie in different stripes, so a burst is spread over all of them."""
    w = window_of(x, chunk)
    return (chunk - w * x["k"] * x["d"]) % window_stripes(x, w)


def position_of(x: Column, chunk: Column) -> Column:
    w = window_of(x, chunk)
    return _div(chunk - w * x["k"] * x["d"], window_stripes(x, w))


def parity_shards(x: Column) -> Column:
    """Parity shards of the whole file."""
    last = _div(chunk_count(x) - 1, x["k"] * x["d"])
    many = last * x["d"] * x["m"] + window_stripes(x, last) * x["m"]
    return F.when(x["scheme"] == SMALL, x["m"].cast("long")).otherwise(many)


def parity_size(x: Column) -> Column:
    return parity_shards(x) * x["shard_size"]


def parity_index(x: Column, window: Column, stripe: Column, j: Column) -> Column:
    """Place of a stripe's j-th parity shard in the file's parity data."""
    return F.when(x["scheme"] == SMALL, j.cast("long")).otherwise(window * x["d"] * x["m"] + stripe * x["m"] + j)


def repairable(stripes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, repairable: no stripe misses more data shards than it has good parity shards. stripes: keys, missing, good_parity."""
    return stripes.groupBy(*keys).agg((F.max(F.col("missing") - F.col("good_parity")) <= 0).alias("repairable"))


# Coding


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms of 2 in GF(2^8)."""
    power, log = np.zeros(510, np.uint8), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    return power, log


@cache
def products() -> np.ndarray:
    """The product of each two field elements, 256 x 256."""
    power, log = tables()
    out = power[log[:, None] + log[None, :]].copy()
    out[0, :] = out[:, 0] = 0
    return out


def multiply(a, b) -> np.ndarray:
    return products()[np.asarray(a, np.uint8), np.asarray(b, np.uint8)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product over the field; b may be wide (shards)."""
    table, out = products(), np.zeros((a.shape[0], b.shape[1]), np.uint8)
    for i, row in enumerate(a):
        for c, shard in zip(row, b):
            if c:
                out[i] ^= shard if c == 1 else table[c].take(shard)
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse by elimination; raises ValueError if singular."""
    power, log = tables()
    n = len(a)
    work = np.concatenate([a.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for i in range(n):
        rows = np.flatnonzero(work[i:, i])
        if not len(rows):
            raise ValueError("singular matrix")
        p = i + int(rows[0])
        work[[i, p]] = work[[p, i]]
        work[i] = multiply(work[i], power[(255 - log[work[i, i]]) % 255])
        for r in range(n):
            if r != i and work[r, i]:
                work[r] ^= multiply(work[i], work[r, i])
    return work[:, n:]


@cache
def coder(k: int, m: int) -> np.ndarray:
    """The m x k parity rows of a systematic Vandermonde code: the identity on top of it is the whole generator."""
    power, log = tables()
    v = np.array([[1 if c == 0 else (0 if r == 0 else power[log[r] * c % 255]) for c in range(k)] for r in range(k + m)], np.uint8)
    return product(v[k:], inverse(v[:k]))


def encode_stripe(data: list[bytes], k: int, m: int, size: int) -> list[bytes]:
    """Parity shards of up to k data shards, short ones filled with zeros."""
    block = np.zeros((k, size), np.uint8)
    for i, d in enumerate(data):
        block[i, : len(d)] = np.frombuffer(d, np.uint8)
    return [row.tobytes() for row in product(coder(k, m), block)]


def repair_stripe(data: dict[int, bytes], parity: dict[int, bytes], present: int, k: int, m: int, size: int) -> dict[int, bytes]:
    """The data shards missing of a stripe that holds `present` of them, from good data and parity; ValueError if too few are good."""
    missing = [i for i in range(present) if i not in data]
    if not missing:
        return {}
    if len(missing) > len(parity):
        raise ValueError(f"{len(missing)} shards are damaged and {len(parity)} parity shards are good")
    full = np.concatenate([np.eye(k, dtype=np.uint8), coder(k, m)])
    rows = [i for i in range(k) if i in data or i >= present] + [k + j for j in sorted(parity)]
    rows = rows[:k]
    shards = np.zeros((k, size), np.uint8)
    for at, r in enumerate(rows):
        raw = data.get(r, b"") if r < k else parity[r - k]
        shards[at, : len(raw)] = np.frombuffer(raw, np.uint8)
    fix = inverse(full[rows])[missing]
    return dict(zip(missing, (x.tobytes() for x in product(fix, shards))))


def split_chunks(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, layout, chunk, window, stripe, pos, shard: the data shards of files with a layout."""
    x = F.col("layout")
    at = F.sequence(F.lit(0), F.ceil(F.octet_length(content) / x["shard_size"]).cast("int") - 1)
    rows = files.where("layout is not null").select(*keys, "layout", F.col(content).alias("data"), F.explode(at).alias("chunk"))
    shard = F.substring(F.col("data"), (F.col("chunk") * x["shard_size"] + 1).cast("int"), x["shard_size"].cast("int"))
    small = x["scheme"] == SMALL
    zero = F.lit(0).cast("long")
    return rows.select(
        *keys, "layout", F.col("chunk").cast("long").alias("chunk"), F.when(small, zero).otherwise(window_of(x, F.col("chunk"))).alias("window"),
        F.when(small, zero).otherwise(stripe_of(x, F.col("chunk"))).alias("stripe"), F.when(small, F.col("chunk").cast("long")).otherwise(position_of(x, F.col("chunk"))).alias("pos"), shard.alias("shard"),
    )


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of one group after another, out of sorted batches; what is held is one batch and the group cut by its end."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = list(zip(*(rows.column(n).to_pylist() for n in names)))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(starts, starts[1:]):
            yield rows.slice(a, b - a)
        held = rows.slice(starts[-1]).combine_chunks() if starts else None
    if held is not None and held.num_rows:
        yield held


def _kind(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + f", window long, stripe long, {rest}"


def encode(shards: DataFrame, keys: list[str]) -> DataFrame:
    """keys, window, stripe, j, parity, sha256 of the parity of split_chunks(). Stripes, 32 shards at most, come one after another."""
    names = [*keys, "window", "stripe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, names):
            x = group.column("layout")[0].as_py()
            made = encode_stripe(group.column("shard").to_pylist(), x["k"], x["m"], x["shard_size"])
            head = [pa.array([group.column(n)[0].as_py()] * len(made), group.schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*head, pa.array(range(len(made)), pa.int32()), pa.array(made, pa.binary()), pa.array([sha256(p).hexdigest() for p in made])], [*names, "j", "parity", "sha256"])

    rows = shards.select(*names, "pos", "layout", "shard").repartition(*names).sortWithinPartitions(*names, "pos")
    return rows.mapInArrow(run, _kind(shards, keys, "j int, parity binary, sha256 string"))


def repair(shards: DataFrame, parity: DataFrame, keys: list[str]) -> DataFrame:
    """keys, window, stripe, pos, shard, ok: damaged data shards rebuilt, each checked against its hash; ok is false where a stripe can't be.

    shards: as split_chunks() with `wanted` (sha256); a lost shard is a null. parity: as encode(), sha256 being what it
    should be. Every shard is hashed before use, so damaged ones never take part. Only stripes with a damaged shard are moved,
    and one stripe at a time is held.
    """
    names = [*keys, "window", "stripe"]
    sound = F.coalesce(F.sha2("shard", 256) == F.col("wanted"), F.lit(False))
    data = shards.select(*names, F.lit(0).alias("role"), F.col("pos").cast("long").alias("at"), F.when(sound, F.col("shard")).alias("raw"), "wanted", "layout")
    spare = parity.where(F.coalesce(F.sha2("parity", 256) == F.col("sha256"), F.lit(False)))
    spare = spare.select(*names, F.lit(1).alias("role"), F.col("j").cast("long").alias("at"), F.col("parity").alias("raw"), F.col("sha256").alias("wanted"), F.lit(None).cast(shards.schema["layout"].dataType).alias("layout"))
    broken = data.where("raw is null").select(*names).distinct()
    rows = data.unionByName(spare).join(broken, names, "left_semi").withColumn("deal", F.xxhash64(*names))
    # dealt by a column of its own: a union of joins on the names may claim their partitioning and lose it at run time
    rows = rows.repartition("deal").sortWithinPartitions("deal", *names, "role", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, names):
            x = group.column("layout")[0].as_py()
            have, spare = {}, {}
            for role, at, raw, want in zip(*(group.column(c).to_pylist() for c in ("role", "at", "raw", "wanted"))):
                if role:
                    spare[at] = raw
                else:
                    have[at] = raw, want
            lost = [at for at, (raw, _) in have.items() if raw is None]
            try:
                if max(have) >= x["k"]:
                    raise ValueError("a shard outside the layout")
                made = repair_stripe({at: raw for at, (raw, _) in have.items() if raw is not None}, spare, max(have) + 1, x["k"], x["m"], x["shard_size"])
            except ValueError:
                made = {}
            fits = []
            for at in lost:
                raw, want = made.get(at), have[at][1]
                # the last shard of a file is shorter: its recorded hash tells at which length
                ends = [] if raw is None else [len(raw), (x["size"] - 1) % x["shard_size"] + 1, len(raw.rstrip(b"\0"))]
                fits.append(next((raw[:n] for n in ends if sha256(raw[:n]).hexdigest() == want), None))
            head = [pa.array([group.column(n)[0].as_py()] * len(lost), group.schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*head, pa.array(lost, pa.int64()), pa.array(fits, pa.binary()), pa.array([f is not None for f in fits])], [*names, "pos", "shard", "ok"])

    return rows.mapInArrow(run, _kind(shards, keys, "pos long, shard binary, ok boolean"))
