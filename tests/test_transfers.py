"""Resuming, ranges of files, restores, host tables."""

from hashlib import sha256

from pyspark.sql import functions as F

from archivolt import sinks, transfers
from archivolt.operators import content, parity, resume, telemetry
from archivolt.sources import host, ranges


def test_staged_shards(spark):
    raw = [bytes([i]) * 4 for i in range(4)]
    wanted = spark.createDataFrame([("f", j, sha256(x).hexdigest()) for j, x in enumerate(raw)], "path string, j int, sha256 string")
    staged = spark.createDataFrame([("f", 0, bytearray(raw[0])), ("f", 1, bytearray(raw[1])), ("f", 2, bytearray(b"bad!")), ("f", 3, bytearray(raw[3]))], "path string, j int, parity binary")
    assert resume.staged_valid(staged, wanted, ["path"]).first().valid == 2
    assert resume.staged_valid(staged.limit(0), wanted, ["path"]).first().valid == 0


def test_headers(spark):
    kind = "struct<source:string,path:string,size:bigint,mtime_ns:bigint,change_id:string,chunk_size:bigint,parity_m:int,recipients:array<string>>"
    a = ("/s", "p", 1, 2, None, 16, 2, ["x", "y"])
    df = spark.createDataFrame([(a, a), (a, (*a[:3], 3, *a[4:])), (a, (*a[:7], ["y", "x"]))], f"a {kind}, b {kind}")
    got = df.select(resume.same_source(F.col("a"), F.col("b")), resume.same_header(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, False)]


def test_ranges(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(100)))
    wanted = spark.createDataFrame([(str(tmp_path / "f"), 10, 5), (str(tmp_path / "f"), 98, 5), (str(tmp_path / "gone"), 0, 5)], "path string, at long, size long")
    got = {(r.path.rsplit("/")[-1], r.at): (r.raw and bytes(r.raw), r.error) for r in host.read_ranges(wanted).collect()}
    assert got == {("f", 10): (bytes(range(10, 15)), None), ("f", 98): (b"bc", None), ("gone", 0): (None, "FileNotFoundError")}


def test_restores_never_overwrite(spark, tmp_path):
    (tmp_path / "old").write_text("mine")
    sha = sha256(b"new").hexdigest()
    files = spark.createDataFrame([("old", bytearray(b"new"), sha), ("sub/new", bytearray(b"new"), sha), ("bad", bytearray(b"other"), sha)], "path string, content binary, sha256 string")
    assert {r.path: r.result for r in sinks.restore_files(files, str(tmp_path)).collect()} == {"old": "EXISTS", "sub/new": "RESTORED", "bad": "FAILED"}
    assert (tmp_path / "old").read_text() == "mine" and (tmp_path / "sub/new").read_bytes() == b"new" and sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["new", "old"]


def test_host_tables(spark):
    lines = spark.createDataFrame([(r"ltfs:/dev/sg1 /mnt/my\040tape fuse rw 0 0",), ("short line",), ("MemTotal:  16 kB",)], "value string")
    assert [tuple(r) for r in host.mounts(lines).where("kind = 'fuse'").collect()] == [("ltfs:/dev/sg1", "/mnt/my tape", "fuse")]
    assert ("MemTotal", 16) in [tuple(r) for r in host.key_values(lines).collect()]


def test_small_parsers(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\x50\x00\x00"),), (bytearray(b"\x03\x00\x00\x01"),), (bytearray(b"\x40\x00\x00\x01"),), (bytearray(b"\x01"),)], "raw binary")
    assert [r[0] and tuple(r[0]) for r in df.select(telemetry.microcode_buffer(F.col("raw"))).collect()] == [(0, 0x500000), (3, 1), (-1, 1), None]
    assert sinks.new_volume("a\tb", None, 5, spark).first().label == "a?b"


def test_damaged_files_are_scanned_and_repaired_in_place(spark, tmp_path):
    """Files read piece by piece: damaged, cut, larger, missing; the stripes hit are read again and rebuilt."""
    import random

    raw = {n: random.Random(n).randbytes(16 * 320 + 16 * 40 + 5) for n in ("ok", "hit", "cut", "long", "gone")}
    rows, listed = [], []
    for name, data in raw.items():
        now = bytearray(data)
        if name == "hit":
            now[16 * 30 : 16 * 50] = bytes(16 * 20)
        now = {"cut": now[: 16 * 358], "long": now + b"x"}.get(name, now)
        if name != "gone":
            (tmp_path / name).write_bytes(now)
        hashes = [sha256(data[i : i + 16]).hexdigest() for i in range(0, len(data), 16)]
        listed.append((name, str(tmp_path / name), len(data), sha256(data).hexdigest(), 16, hashes))
        rows.append((name, bytearray(data)))
    layout = parity.layout(F.col("size"), F.lit(16).cast("long"), F.lit(2))
    entries = spark.createDataFrame(listed, "path string, stored_path string, size long, sha256 string, chunk_size long, chunk_sha256 array<string>").withColumn("layout", layout)
    found = ranges.scan_files(entries)
    got = {r.path: (r.bad, r.tail, content_ok) for r in found.withColumn("ok", content.is_intact()).collect() for content_ok in [r.ok]}
    assert got["ok"] == ([], None, True) and got["hit"] == (list(range(30, 50)), None, False) and got["cut"] == ([], 358, False) and not got["long"][2] and not got["gone"][2]
    whole = spark.createDataFrame(rows, "path string, content binary").withColumn("size", F.octet_length("content").cast("long")).withColumn("layout", layout)
    coded = parity.encode(parity.split_chunks(whole, ["path"]), ["path"])
    fixed = parity.repair(ranges.data_shards(found, ["path"]), coded, ["path"]).collect()
    assert all(r.ok for r in fixed) and {r.path for r in fixed} == {"hit", "cut"} and len(fixed) == 20 + 3
    assert sorted(bytes(r.shard) for r in fixed if r.path == "hit") == sorted(raw["hit"][i * 16 : i * 16 + 16] for i in range(30, 50))


def test_files_are_archived_and_deleted_as_planned(spark, tmp_path):
    src, tape = tmp_path / "src", tmp_path / "tape"
    (src / "a/b").mkdir(parents=True)
    data = {"a/b/one": b"x" * 1000, "a/two": b"", "three": b"y" * 37, "late": b"z", "there": b"t"}
    for n, x in data.items():
        (src / n).write_bytes(x)
    tape.mkdir()
    (tape / "there").write_bytes(b"old")
    stat = {n: (src / n).stat() for n in data}
    rows = [(str(src / n), n, s.st_size, s.st_mtime_ns) for n, s in stat.items()] + [(str(src / "gone"), "gone", 1, 1)]
    (src / "late").write_bytes(b"longer")
    files = spark.createDataFrame(rows, "source string, path string, size long, mtime_ns long")
    got = {r.path: r for r in transfers.archive_files(files, str(tape), 16).collect()}
    assert {n: r.result for n, r in got.items()} == {"a/b/one": "ARCHIVED", "a/two": "ARCHIVED", "three": "ARCHIVED", "late": "CHANGED", "there": "EXISTS", "gone": "UNREADABLE"}
    one = got["a/b/one"]
    assert (tape / "a/b/one").read_bytes() == data["a/b/one"] and one.sha256 == sha256(data["a/b/one"]).hexdigest() and len(one.chunks) == 63 and one.chunks[-1] == sha256(b"x" * 8).hexdigest()
    assert (tape / "there").read_bytes() == b"old" and not [p for p in tape.rglob("*.partial")] and got["a/two"].chunks == []
    (src / "link").symlink_to(src / "a")
    planned = spark.createDataFrame([("a/b/one", 1000, rows[0][3], "DELETE"), ("late", 1, rows[3][3], "DELETE"), ("link/two", 0, rows[1][3], "DELETE"), ("none", 1, 1, "DELETE"), ("three", 37, rows[2][3], "KEEP")], "path string, size long, mtime_ns long, decision string")
    assert {r.path: r.result for r in transfers.delete_files(planned, str(src)).collect()} == {"a/b/one": "DELETED", "late": "CHANGED", "link/two": "OUTSIDE", "none": "GONE"}
    assert transfers.remove_folders(["a", "a/b", "link"], str(src)) == ["a/b"] and (src / "a/two").exists() and (src / "three").exists()
