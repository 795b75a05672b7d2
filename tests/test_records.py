"""Validation, record lines and tapes on disk."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from archivolt import schemas, sinks
from archivolt.functions import scalars, validate
from archivolt.sources import jsonl, tapes

SHA = "ab" * 32
ID = "12345678-1234-1234-1234-123456789abc"


def test_paths(spark):
    good = ["a", "a/b.iso", "..a", "a..b/c", ".archived"]
    bad = ["", "/a", "../a", "a/../b", "./a", "a//b", "a/", "a\nb", "a\rb", ".archive", ".archive/x", "SHA256SUMS", ".", ".."]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string").withColumn("ok", validate.valid_path(F.col("p")))
    assert {r.p for r in df.where("ok").collect()} == set(good)


def test_ids(spark):
    bad = [ID.upper(), ID[:-1], ID + "0", ID.replace("-", "0"), "", "x" * 36]
    df = spark.createDataFrame([(p,) for p in [ID, *bad]], "p string").withColumn("ok", validate.valid_id(F.col("p")))
    assert [r.p for r in df.where("ok").collect()] == [ID]


def test_labels(spark):
    df = spark.createDataFrame([("plain",), ("a\tb\x7f",), ("é" * 100,), ("x" * 127 + "é",)], "p string")
    assert [r[0] for r in df.select(validate.clean_label(F.col("p"))).collect()] == ["plain", "a?b?", "é" * 64, "x" * 127]


@pytest.fixture
def tape(tmp_path):
    d = tmp_path / "segments"
    d.mkdir()

    def line(path, **more):
        return json.dumps({"path": path, "size": 5, "sha256": SHA, "mtime": "2024-01-02T03:04:05.123456789Z", "archived_at": "2024-01-03T00:00:00Z"} | more)

    (d / "000001.manifest.jsonl").write_text(line("a") + "\n" + line("b", ref={"tape": ID, "path": "a"}) + "\r\n")
    (d / "000003.manifest.jsonl").write_text(line("c") + "\n{torn\n" + line("../d") + "\n" + line("e", ref={"tape": ID}) + "\n" + line("f") + " trailing\n\n" + line("g"))
    (d / "000000.manifest.jsonl").write_text(line("zero"))
    (d / "12.manifest.jsonl").write_text(line("short"))
    (d / "000001.chunks.jsonl").write_text(json.dumps({"path": "a", "chunk_size": 16, "sha256": [SHA]}) + "\n")
    (d / "000003.chunks.jsonl").write_text(json.dumps({"path": "a", "chunk_size": 32, "sha256": [SHA]}) + "\n" + json.dumps({"path": "a", "chunk_size": 1, "sha256": []}))
    return tmp_path


def test_a_tape_is_read(spark, tape):
    assert [r.segment for r in tapes.segments(spark, str(tape)).collect()] == [1, 3]
    rows, bad = tapes.entries_lenient(spark, str(tape))
    got = [(r.segment, r.line_no, r.path, r.mtime_ns % 1_000_000_000) for r in rows.orderBy("segment", "line_no").collect()]
    assert got == [(1, 1, "a", 123456789), (1, 2, "b", 123456789), (3, 1, "c", 123456789), (3, 7, "g", 123456789)]
    assert [r.bad for r in bad.collect()] == [4]
    chunks, bad = tapes.chunk_lists(spark, str(tape))
    assert [(r.path, r.chunk_size, r.segment) for r in chunks.collect()] == [("a", 32, 3)]
    with pytest.raises(PySparkException, match="line 2"):
        tapes.entries(spark, str(tape)).collect()


def test_a_pending_log_with_a_torn_tail(spark, tmp_path):
    ok = json.dumps({"entry": {"path": "a", "size": 1, "sha256": SHA}})
    (tmp_path / "torn.jsonl").write_text(ok + "\n" + ok[:20])
    (tmp_path / "damaged.jsonl").write_text(ok[:20] + "\n" + ok + "\n")
    rows, state = tapes.pending_log(spark, str(tmp_path / "torn.jsonl"))
    assert rows.count() == 1 and state.first().torn and state.first().damaged_at is None
    assert tapes.pending_log(spark, str(tmp_path / "damaged.jsonl"))[1].first().damaged_at == 1


def test_a_journal_stops_at_its_first_bad_record(spark, tmp_path):
    lines = [{"offset": 16, "chunks": ["a"]}, {"offset": 32, "chunks": ["b"]}, {"offset": -1}, {"offset": 48, "chunks": ["c"]}]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = tapes.journal_log(spark, str(tmp_path / "j.jsonl")).orderBy("line_no").collect()
    assert [(r.offset, r.chunks) for r in got] == [(16, ["a"]), (32, ["a", "b"])]


def test_missing_files_are_optional(spark, tmp_path):
    assert tapes.optional(tapes.volume, spark, str(tmp_path / "none")) is None


def test_checksums_are_written_once(spark, tmp_path):
    row = (ID, 1, 1, "a", 5, SHA, None, None)
    df = spark.createDataFrame([row, (ID, 1, 2, "b", 5, SHA, (ID, "a"), None)], f"tape_id string, segment int, line_no long, path string, size long, sha256 string, ref {schemas.REF}, age {schemas.AGE}")
    path = str(tmp_path / "sums")
    assert sinks.ensure_checksums(df, path) and not sinks.ensure_checksums(df, path)
    assert [r.value for r in spark.read.text(path).collect()] == [f"{SHA}  a"]


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, SHA), ("b", 2, SHA)], "path string, size long, sha256 string")
    sinks.write_lines(df, str(tmp_path / "x"))
    back, bad = jsonl.read_lenient(spark, str(tmp_path / "x"), schemas.ENTRY_LINE, validate.entry_problem())
    assert sorted(r.path for r in back.collect()) == ["a", "b"] and bad.isEmpty()


def test_scalars(spark):
    one = spark.range(1)
    get = lambda *c: list(one.select(*c).first())
    assert get(*(scalars.format_bytes(F.lit(n).cast("long")) for n in (5, 1024, 1536, 3 << 30))) == ["5 B", "1.0 KiB", "1.5 KiB", "3.0 GiB"]
    assert get(scalars.format_duration(F.lit(3661.6))) == ["01:01:02"]
    assert get(scalars.be_uint(F.unhex(F.lit("F" * 16))).cast("string"), scalars.be_uint(F.lit(b""))) == [str(2**64 - 1), None]
    assert get(scalars.mega_and_bytes(F.lit(str(2**64 - 1)).cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)")).cast("string")) == [str(2**64 - 1)]
    assert get(scalars.term_safe(F.lit("a\x1b[0m\nb\x85"))) == ["a\\x1b[0m\nb\\x85"]
    assert get(scalars.ebcdic(F.lit(bytes([0xC1, 0x40, 0xF1, 0x00, 0x82])))) == ["A 1b"]
    assert get(scalars.key_id(F.lit(b"KEY" + bytes(9))), scalars.key_id(F.lit(b"name")), scalars.key_id(F.lit(b"\x00\x01"))) == ["KEY" + "00" * 9, "name", "0001"]
    assert get(scalars.metadata_reserve(F.lit(4).cast("long"), F.lit(1010).cast("long"))) == [(256 << 20) + 1600]
