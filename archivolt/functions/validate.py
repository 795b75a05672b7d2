"""Untrusted records: each rule as a predicate, or the reason a record is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.operators.parity import layout_problem

# Bounds of what records may say.
MAX_SIZE = 1 << 50
MIN_CHUNK, MAX_CHUNK = 16, 16 << 20
MAX_RECIPIENTS, MAX_RECIPIENT = 64, 4096
LABEL_BYTES = 128
AGE_CHUNK, AGE_TAG, AGE_HEADER = 65536, 16, 1 << 20


def valid_path(path: Column, meta_dir: str = ".archive", sums: str = "SHA256SUMS") -> Column:
    """Non-empty, relative and clean (no empty, . or .. component), without NUL, LF or CR, outside the metadata folder, not the sums file."""
    clean = ~path.rlike(r"(^|/)(\.{0,2})(/|$)") & ~path.rlike(r"[\x00\n\r]")
    return F.coalesce(path.isNotNull() & (path != "") & clean & (path != meta_dir) & ~path.startswith(f"{meta_dir}/") & (path != sums), F.lit(False))


def valid_id(value: Column) -> Column:
    """A UUID in lower case."""
    return F.coalesce(value.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.lit(False))


def valid_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def sealed_size(size: Column) -> Column:
    """Least size of an encrypted form without its header: 16 bytes more for each 64 KiB, one piece at least."""
    return size + AGE_TAG * F.greatest(F.ceil(size / AGE_CHUNK), F.lit(1))


def entry_problem(path=None, size=None, sha256=None, ref=None, age=None, recovered=None) -> Column:
    """Why an entry is refused, else null. Missing fields count as empty or 0, as its writer would read them."""
    c = lambda x, name: F.col(name) if x is None else x
    path, size, sha, ref, age, recovered = c(path, "path"), F.coalesce(c(size, "size"), F.lit(0)), c(sha256, "sha256"), c(ref, "ref"), c(age, "age"), F.coalesce(c(recovered, "recovered"), F.lit(False))
    least = sealed_size(size)
    age_size = F.coalesce(age["size"], F.lit(0))
    who = F.coalesce(age["recipients"], F.array().cast("array<string>"))
    return (
        F.when(~valid_path(path), "invalid path")
        .when(~size.between(0, MAX_SIZE), "invalid size")
        .when(~valid_sha256(sha), "invalid SHA-256")
        .when(ref.isNotNull() & ~(valid_id(ref["tape"]) & valid_path(ref["path"])), "invalid reference")
        .when(age.isNotNull() & (ref.isNotNull() | recovered), "encrypted reference or recovered file")
        .when(age.isNotNull() & ~((age_size > least) & (age_size <= least + AGE_HEADER + 16)), "invalid encrypted size")
        .when(age.isNotNull() & ~valid_sha256(age["sha256"]), "invalid encrypted SHA-256")
        .when(age.isNotNull() & (~F.size(who).between(1, MAX_RECIPIENTS) | F.exists(who, lambda r: ~r.rlike(r"\A[!-~]+\z") | (F.length(r) > MAX_RECIPIENT))), "invalid recipients")
    )


def chunks_problem() -> Column:
    return (
        F.when(~valid_path(F.col("path")), "invalid path")
        .when(~F.coalesce(F.col("chunk_size"), F.lit(0)).between(MIN_CHUNK, MAX_CHUNK), "invalid chunk size")
        .when(F.exists(F.coalesce("sha256", F.array().cast("array<string>")), lambda h: ~valid_sha256(h)), "invalid chunk hash")
    )


def parity_problem(shards: Column) -> Column:
    """Why a parity record is refused; shards: the number of parity shards its layout needs."""
    data = F.coalesce("data_hashes", F.array().cast("array<string>"))
    hashes = F.coalesce("hashes", F.array().cast("array<string>"))
    x = F.col("layout")
    return (
        F.when(~valid_path(F.col("path")), "invalid path")
        .when(x.isNull(), "no layout")
        .otherwise(
            F.coalesce(
                layout_problem(x),
                F.when(~F.coalesce(F.col("offset"), F.lit(0)).between(0, MAX_SIZE), "invalid offset")
                .when(F.size(hashes) != shards, "wrong number of parity hashes")
                .when((x["scheme"] == "rs-small") & (F.size(data) != x["k"]) | (x["scheme"] != "rs-small") & (F.size(data) > 0), "wrong number of data hashes")
                .when(F.exists(F.concat(hashes, data), lambda h: ~valid_sha256(h)), "invalid parity hash"),
            )
        )
    )


def pending_problem() -> Column:
    """Why a pending record (entry, chunks, parity) is refused: its parts must name the same file at the same stored size."""
    e, c, p = F.col("entry"), F.col("chunks"), F.col("parity")
    stored = F.coalesce(e["age"]["size"], e["size"])
    return F.coalesce(
        entry_problem(e["path"], e["size"], e["sha256"], e["ref"], e["age"], e["recovered"]),
        F.when(c.isNotNull() & (c["path"] != e["path"]), "chunk list of another file"),
        F.when(p.isNotNull() & (p["path"] != e["path"]), "parity of another file"),
        F.when(p.isNotNull() & (p["layout"]["size"] != stored), "parity of another size"),
    )


def clean_label(label: Column) -> Column:
    """Control characters become ?, and at most 128 bytes stay, cut between characters."""
    text = F.regexp_replace(label, r"[\x00-\x1f\x7f-\x{9f}]", "?")
    return F.when(F.octet_length(text) <= LABEL_BYTES, text).otherwise(_cut(text))


def _cut(text: Column) -> Column:
    """The longest prefix of whole characters within the limit."""
    n = F.aggregate(
        F.transform(F.split(text, ""), lambda ch: F.octet_length(ch)), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"), F.lit(False).alias("full")),
        lambda s, b: F.when(s["full"] | (s["bytes"] + b > LABEL_BYTES), F.struct(s["bytes"].alias("bytes"), s["chars"].alias("chars"), F.lit(True).alias("full"))).otherwise(F.struct((s["bytes"] + b).alias("bytes"), (s["chars"] + 1).alias("chars"), F.lit(False).alias("full"))),
        lambda s: s["chars"],
    )
    return F.substring(text, F.lit(1), n)


def valid_label(label: Column) -> Column:
    return label == clean_label(label)
