"""Captured bytes: log pages, error history, firmware; the drive watch as a stream against its step function."""

import struct

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt import device_queries, queries
from archivolt.operators import firmware, telemetry
from archivolt.streaming import watch


def page(code, params):
    body = b"".join(struct.pack(">HBB", c, 0, len(v)) + v for c, v in params)
    return bytearray(struct.pack(">BBH", code, 0, len(body)) + body)


def params(spark, *pages):
    df = spark.createDataFrame([("d", p) for p in pages], "drive string, raw binary")
    return telemetry.log_params(df, ["drive"])


def test_a_torn_page_keeps_what_was_received(spark):
    raw = page(2, [(3, b"\x05"), (6, b"\x00\x02")])[:-1]
    assert [(r.code, bytes(r.value)) for r in params(spark, raw).collect()] == [(3, b"\x05")]


def test_counters_distinguish_zero_from_missing(spark):
    got = telemetry.error_counters(params(spark, page(2, [(3, b"\x00"), (6, b"\xff" * 8), (6, b"\x01"), (5, b"")])), ["drive"], 2).first()
    assert (got.corrected, got.uncorrected, got.bytes) == (0, 2**64 - 1, None)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_any_bytes_are_parsed_without_error(raw):
    for f in (telemetry.log_page, telemetry.attribute_list, telemetry.phys):
        f(raw)
    firmware.inspect(raw)


def test_status_alerts_and_links(spark):
    sas = b"\x06\x00\x00\x02" + b"\x00\x00\x00\x04\x00\x0a\x00\x00" + b"\x00\x01\x00\x04\x00\x07\x00\x00"
    p = params(spark, page(0x11, [(0, b"\x06\x11\x05\x00")]), page(0x2E, [(4, b"\x01"), (10, b"\x01"), (5, b"\x00"), (48, b"\x01")]), page(0x18, [(1, sas)]))
    s = telemetry.device_status(p, ["drive"]).first()
    assert s.activity == "reading" and s.cleaning == "drive needs cleaning now" and s.mounted and s.medium_present and not s.threaded
    assert [(r.flag, r.severity) for r in telemetry.tape_alerts(p, ["drive"]).orderBy("flag").collect()] == [(4, "critical"), (10, "info"), (48, "warning")]
    assert [(r.link, r.rate) for r in telemetry.link_rates(p, ["drive"]).orderBy("phy").collect()] == [("port 1 phy 0", "6 Gbps"), ("port 1 phy 1", "rate 0x7")]


def test_head_hours(spark):
    d = lambda code, worm, h: struct.pack(">BBBBI", 0, 0, code, worm, h)
    raw = d(0x5A, 0, 10) + d(0x58, 4, 5) + d(0x5C, 0, 0) + d(0x99, 0, 7) + b"\x00\x00"
    got = telemetry.head_hours(params(spark, page(0x14, [(0x1000, raw), (0, b"\x03"), (0x81, b"\x01")])), ["drive"]).orderBy("ord").collect()
    assert [(r.format, r.hours) for r in got] == [("LTO-6", 10), ("LTO-5 WORM", 5), ("density 0x99", 7)]


def entry(key, asc, medium, firmware=b"NEW1"):
    b = bytearray(68)
    b[2], b[9], b[10], b[24] = 0x5A, key, asc, 0x0A
    b[16:20], b[28 : 28 + len(medium)] = firmware, medium
    return bytes(b)


def test_error_history(spark):
    rows = [entry(3, 0x11, b"A"), entry(3, 0x0C, b"A"), entry(3, 0x11, b"A"), entry(3, 0x11, b"B"), entry(3, 0x99, b"C"), entry(3, 0x11, b""), entry(4, 0x44, b"", b"OLD1"), bytes(68)]
    log, slots = telemetry.error_log(params(spark, page(0x16, list(enumerate(rows)))), ["drive"])
    assert slots.first().slots == 8 and log.count() == 7
    got = {r.medium: (r.errors, r.kinds) for r in telemetry.medium_errors(log, ["drive"]).collect()}
    assert got == {"A": (3, ["unrecovered read error", "write error"]), "B": (1, ["unrecovered read error"]), "C": (1, []), "unknown cartridge": (1, ["unrecovered read error"])}
    r = telemetry.analyse_errors(log, ["drive"], "NEW1").first()
    assert (r.media, r.drive_suspected, r.hardware_errors, r.older_entries, r.older_levels) == (4, True, 1, 1, ["OLD1"])
    assert log.where("asc = 153").first().description == "medium error (ASC 0x99, ASCQ 0x00)"


def test_sense(spark):
    fixed, described = bytearray(18), bytearray([0x72, 3, 0x11, 0, 0])
    fixed[0], fixed[2], fixed[12] = 0x70, 0x23, 0x3A
    df = spark.createDataFrame([(fixed,), (described,), (bytearray(b"\x70"),)], "raw binary")
    assert [tuple(r[0]) for r in df.select(telemetry.sense(F.col("raw"))).collect()] == [(3, 0x3A, 0), (3, 0x11, 0), (0, 0, 0)]


def test_cartridge(spark):
    def attr(i, v):
        return struct.pack(">HBH", i, 0x80, len(v)) + v

    body = attr(0x0401, b"SER 1  ") + attr(0x0405, b"\x5a") + attr(0x0408, b"\x80") + attr(0, (5).to_bytes(8)) + attr(0x0401, b"SER2")
    df = spark.createDataFrame([("d", bytearray(struct.pack(">I", len(body)) + body))], "drive string, raw binary")
    r = telemetry.cartridge(telemetry.attributes(df, ["drive"]), ["drive"]).first()
    assert (r.serial, r.format, r.kind, r.remaining_mib, r.capacity_mib) == ("SER2", "LTO-6", "WORM", 5, None)


def image():
    data = bytes(range(64))
    b = bytearray(0x48)
    b[8:12], b[12:16], b[0x20:0x28] = b"LOAD", b"LVL1", firmware.MAGIC
    name = b"sas_hh_x"
    attr_at = len(b)
    b += struct.pack(">III", 9, 24, len(name)) + bytes(12) + name
    table = len(b)
    b += bytes(24)
    at = len(b)
    b += data + struct.pack(">I", 0x01000004) + struct.pack(">I", firmware.word_sum(data)) + struct.pack(">I", 0x02000004) + struct.pack(">I", firmware.crc(data)) + bytes(4)
    b[table : table + 24] = b"CODE" + struct.pack(">IIIII", 0x03000000, at, len(data), 0, 0)
    b += bytes(4)
    total = len(b) + 8 + 12
    struct.pack_into(">I", b, 4, total)
    struct.pack_into(">IIII", b, 0x38, table, 24, attr_at, 24)
    b += struct.pack(">I", firmware.crc(bytes(b))) + struct.pack(">I", 0x02000004)
    b += b"SIGNED!!" + struct.pack(">I", 0x08000008)
    return bytes(b)


def test_firmware(spark):
    keys = {firmware.SHA256: lambda data, sig: sig == b"SIGNED!!"}
    good = firmware.inspect(image(), keys)
    assert good["problems"] == [] and good["platform"] == "sas_hh_x" and good["sections"][0]["sum"] == good["sections"][0]["crc"] == "OK"
    bad = bytearray(image())
    bad[-60] ^= 1
    assert firmware.inspect(bytes(bad), keys)["problems"]
    df = spark.createDataFrame([("ok", bytearray(image())), ("no", bytearray(b"zip"))], "path string, content binary")
    got = {r.path: (r.valid, r.report is None) for r in firmware.inspected(df, None).collect()}
    assert got == {"ok": (False, False), "no": (False, True)}  # without a key the signature can't be confirmed
    same = spark.createDataFrame([("sas_hh_x", "sas_hh_y"), ("sas_hh", "sas_fh"), ("a", "a")], "i string, d string").select(firmware.platform_matches(F.col("i"), F.col("d")))
    assert [r[0] for r in same.collect()] == [True, False, True]


def test_the_watch_reports_each_thing_once():
    state, told = None, []
    polls = [("", {"p": "6"}, 5, 0), ("", {"p": "3", "q": "6"}, 5, 2), ("clean", {"p": "3"}, 4, 2), ("clean", {}, None, 3), ("", {"p": "6"}, 9, 3)]
    for t, p in enumerate(polls):
        state, out = watch.step(state, t, *p)
        told += out
    assert told == [(1, "link", "p", "6", "3"), (1, "errors", "read", "0", "2"), (2, "cleaning", "clean", None, "running"), (3, "link", "p", "3", None), (3, "errors", "read", "2", "3"), (4, "errors", "write", "0", "4")]


def test_the_stream_equals_the_batch_form(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((r.drive, r.ts, r.kind, r.what or "", r.was or "", r.now or "") for r in device_queries.drive_watch(spark, sf).collect())
    want, state = [], {}
    for p in device_queries.drive_polls(spark.read.parquet(f"{sf}/events.parquet")).orderBy("ts").collect():
        state[p.drive], out = watch.step(state.get(p.drive), p.ts, p.cleaning or None, {x.link: x.rate for x in p.links}, p.write_uncorrected, p.read_uncorrected)
        want += [(p.drive, t, k, w or "", a or "", b or "") for t, k, w, a, b in out]
    assert got == sorted(want) and got


def test_segments_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("t", "a", 1, 5), ("t", "b", 2, 0), ("t", "c", 3, 5)], "tape_id string, path string, line_no long, size long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tape_id string, path string, line_no long, size long").parquet(str(tmp_path / "in"))
    watch.write_batches(watch.assign_segments(stream, 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.path: r.segment for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 1, "b": 2, "c": 2}


def test_drive_stats_keep_numbers_of_any_size(spark, tmp_path):
    pairs = [(1, 65535), (2, 65536), (3, 89999), (2**32, 2**40), (2**63 - 1, 2**63 - 1)]
    spark.createDataFrame(pairs, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = device_queries.drive_stats(spark, str(tmp_path)).collect()
    cols = ["event_id", "loads", "cleanings", "temperature_exceeded", "power_cycles"]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL['drive_stats']})").fetchall()
    assert sorted(tuple(r[n] for n in cols) for r in got) == sorted(want)
    assert sorted((r[0], r[2]) for r in want) == pairs
