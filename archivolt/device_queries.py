"""Registered queries over captured drive bytes: each event of the events table is written as the bytes a drive would send, then read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions import scalars
from archivolt.operators import telemetry
from archivolt.queries import query, table
from archivolt.streaming.watch import watch_drives
from archivolt.shared import fresh_path

KEYS = ["event_id"]


def whole() -> Column:
    """The events' value as a whole number."""
    return F.floor(F.abs("value")).cast("long")


def be(n: Column | int, size: int) -> Column:
    """A number as big-endian bytes, in hex."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def text(value: Column | str, size: int) -> Column:
    """Text padded with blanks, in hex."""
    return F.hex(F.rpad(F.lit(value) if isinstance(value, str) else value, size, " ").cast("binary"))


def param(code: Column | int, body: Column) -> Column:
    """A log parameter: code, flags, length, value."""
    return F.concat(be(code, 2), F.lit("00"), be(F.length(body) / 2, 1), body)


def page(code: int, *params: Column) -> Column:
    body = F.concat(*params)
    return F.unhex(F.concat(be(code, 1), F.lit("00"), be(F.length(body) / 2, 2), body))


def params_of(spark, sf_dir: str, code: int, *params: Column):
    e = table(spark, sf_dir, "events")
    return telemetry.log_params(e.select("event_id", page(code, *params).alias("raw")), KEYS)


@query("SELECT event_id, user_id AS corrected, event_id * 1000 AS bytes, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(abs(value)) AS BIGINT) END AS uncorrected FROM events")
def error_counters(spark, sf_dir):
    """Error counters of a page, absent ones null."""
    last = F.when(F.col("event_id") % 3 != 0, param(6, be(whole(), 4))).otherwise("")
    rows = params_of(spark, sf_dir, telemetry.WRITE_ERRORS, param(3, be(F.col("user_id"), 8)), param(5, be(F.col("event_id") * 1000, 8)), last)
    found = telemetry.error_counters(rows, KEYS, telemetry.WRITE_ERRORS)
    return found.select("event_id", *(F.col(c).cast("long").alias(c) for c in ("corrected", "bytes", "uncorrected")))


@query("""
    SELECT event_id, flag, CASE WHEN flag IN (4, 5, 6, 9, 13, 14, 16, 20, 22, 23, 30, 31, 33, 38, 51, 52, 53, 54, 55, 56) THEN 'critical' WHEN flag IN (10, 11, 12, 19) THEN 'info' ELSE 'warning' END AS severity
    FROM (SELECT event_id, CAST(event_id % 64 + 1 AS INTEGER) AS flag FROM events)
""")
def tape_alerts(spark, sf_dir):
    """Alert flags that are set, with their severity."""
    flag = F.col("event_id") % 64 + 1
    rows = params_of(spark, sf_dir, telemetry.TAPE_ALERT, param(flag, F.lit("01")), param(flag % 64 + 1, F.lit("00")))
    return telemetry.tape_alerts(rows, KEYS).select("event_id", "flag", "severity")


@query("""
    SELECT event_id, CAST(user_id % 4 + 1 AS INTEGER) AS port, 'port ' || (user_id % 4 + 1) || ' phy ' || (event_id % 3) AS link,
           CASE event_id % 16 WHEN 8 THEN '1.5 Gbps' WHEN 9 THEN '3 Gbps' WHEN 10 THEN '6 Gbps' WHEN 11 THEN '12 Gbps' WHEN 12 THEN '22.5 Gbps' WHEN 0 THEN 'unknown rate' WHEN 1 THEN 'disabled' WHEN 2 THEN 'reset problem'
                WHEN 3 THEN 'spinup hold' WHEN 4 THEN 'port selector' WHEN 5 THEN 'reset in progress' WHEN 6 THEN 'unsupported phy attached' WHEN 7 THEN 'rate 0x7' WHEN 13 THEN 'rate 0xd' WHEN 14 THEN 'rate 0xe' ELSE 'rate 0xf' END AS rate FROM events
""")
def link_rates(spark, sf_dir):
    """SAS links of a port page; a descriptor that doesn't fit is left out."""
    phy = F.concat(F.lit("00"), be(F.col("event_id") % 3, 1), F.lit("000400"), be(F.col("event_id") % 16, 1), F.lit("0000"))
    rows = params_of(spark, sf_dir, telemetry.PROTOCOL_PORT, param(F.col("user_id") % 4 + 1, F.concat(F.lit("06000002"), phy, F.lit("0001"))))
    return telemetry.link_rates(rows, KEYS).select("event_id", "port", "link", "rate")


@query("""
    SELECT event_id, event_id & 4 <> 0 AS clean_requested, event_id & 2 <> 0 AS clean_required, event_id & 8 <> 0 AS write_protect, user_id & 16 <> 0 AS medium_present,
           coalesce(['idle', 'cleaning', 'loading', 'unloading', 'other medium activity', 'reading', 'writing', 'locating'][event_id % 9 + 1], 'rewinding') AS activity,
           CASE WHEN event_id & 2 <> 0 THEN 'drive needs cleaning now' WHEN event_id & 4 <> 0 THEN 'drive requests cleaning' END AS cleaning FROM events
""")
def device_status(spark, sf_dir):
    """Status bits, activity and the cleaning warning."""
    body = F.concat(be(F.col("event_id") % 256, 1), be(F.col("user_id") % 256, 1), be(F.col("event_id") % 9, 1), F.lit("00"))
    rows = telemetry.device_status(params_of(spark, sf_dir, telemetry.DEVICE_STATUS, param(0, body)), KEYS)
    return rows.select("event_id", "clean_requested", "clean_required", "write_protect", "medium_present", "activity", "cleaning")


@query("SELECT event_id, event_id AS loads, user_id AS cleanings, event_id % 2 = 1 AS temperature_exceeded, CAST(NULL AS BIGINT) AS power_cycles FROM events")
def drive_stats(spark, sf_dir):
    """A drive's statistics."""
    rows = params_of(spark, sf_dir, telemetry.DEVICE_STATS, param(0, be(F.col("event_id"), 8)), param(1, be(F.col("user_id"), 8)), param(0x81, be(F.col("event_id") % 2, 1)))
    return telemetry.drive_stats(rows, KEYS).select("event_id", *(F.col(c).cast("long").alias(c) for c in ("loads", "cleanings", "power_cycles")), "temperature_exceeded")


@query("SELECT event_id, user_id * 1000000 + event_id AS to_host, event_id * 1000000 + user_id AS from_tape, CAST(NULL AS BIGINT) AS to_tape FROM events")
def compression_counts(spark, sf_dir):
    """Megabytes and bytes of a compression page as one number; null if one is missing."""
    u, e = F.col("user_id"), F.col("event_id")
    rows = params_of(spark, sf_dir, telemetry.COMPRESSION, param(2, be(u, 4)), param(3, be(e, 4)), param(4, be(e, 4)), param(5, be(u, 4)), param(8, be(u, 4)))
    return telemetry.compression(rows, KEYS).select("event_id", *(F.col(c).cast("long").alias(c) for c in ("to_host", "from_tape", "to_tape")))


@query("SELECT event_id, event_id + 1 AS mounts, user_id AS write_unrecovered, FALSE AS temperature_exceeded FROM events WHERE event_id % 2 = 0")
def volume_stats(spark, sf_dir):
    """A cartridge's statistics, where the page reports mounts or retries."""
    first = F.when(F.col("event_id") % 2 == 0, param(1, be(F.col("event_id") + 1, 4))).otherwise("")
    rows = telemetry.volume_stats(params_of(spark, sf_dir, telemetry.VOLUME_STATS, first, param(4, be(F.col("user_id"), 4))), KEYS)
    return rows.select("event_id", F.col("mounts").cast("long").alias("mounts"), F.col("write_unrecovered").cast("long").alias("write_unrecovered"), "temperature_exceeded")


@query("""
    SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'LTO-5' ELSE '' END AS format, event_id % 2 = 1 AS repeated, CASE WHEN value > 50 THEN 'medium error: unrecovered read error' ELSE 'hardware error: write error' END AS description,
           CASE WHEN value > 50 THEN 'read' ELSE 'write' END AS operation, 'M' || user_id AS medium_id, event_id AS motion_hours, user_id AS vendor_code, 'AB12' AS firmware,
           CASE WHEN event_id = 0 THEN '' WHEN event_id >= 24 THEN (event_id // 24) || 'd ' || (event_id % 24) || 'h after a power-on' ELSE event_id || 'h 5m after a power-on' END AS happened
    FROM (SELECT event_id % 1000 AS event_id, event_id AS id, user_id, coalesce(value, 0) AS value FROM events) WHERE id < 1000
""")
def error_history(spark, sf_dir):
    """A drive's error history, one slot for each event."""
    e, bad = F.col("event_id"), F.coalesce("value", F.lit(0.0)) > 50
    slot = F.concat(
        F.lit("0000"), F.when(F.col("user_id") % 2 == 0, "58").otherwise("00"), F.lit("00"), be(e, 4), F.lit("00"), be(F.when(bad, 3).otherwise(4) + 128 * (e % 2), 1), F.when(bad, "11").otherwise("0C"), F.lit("00"),
        be(F.col("user_id"), 4), text("AB12", 4), be(0, 4), F.when(bad, "08").otherwise("0A"), F.lit("000000"), text(F.concat(F.lit("M"), F.col("user_id").cast("string")), 32), F.lit("0000"),
        be(F.when(e > 0, e * 3_600_000 + 300_000).otherwise(0), 6),
    )
    rows = table(spark, sf_dir, "events").where("event_id < 1000").select("event_id", page(telemetry.DIAGNOSTICS, param(e + 1, slot)).alias("raw"))
    log, _ = telemetry.error_log(telemetry.log_params(rows, KEYS), KEYS)
    return log.select("event_id", "format", "repeated", "description", "operation", "medium_id", "motion_hours", "vendor_code", "firmware", "happened")


@query("SELECT event_id, event_id % 32 AS device_type, 'ACME' AS vendor, event_type AS product, 'R' || (event_id % 10) AS revision FROM events")
def inquiry(spark, sf_dir):
    """Identity of a drive from its inquiry data."""
    raw = F.unhex(F.concat(be(F.col("event_id") % 64, 1), F.lit("00" * 7), text("ACME", 8), text(F.col("event_type"), 16), text(F.concat(F.lit("R"), (F.col("event_id") % 10).cast("string")), 4)))
    return table(spark, sf_dir, "events").select("event_id", telemetry.inquiry(raw).alias("x")).select("event_id", "x.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 16 END AS key, CASE WHEN event_id % 3 = 2 THEN 0 ELSE user_id % 256 END AS asc, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 7 END AS ascq FROM events")
def sense_data(spark, sf_dir):
    """Sense data of both formats; what is too short counts as 0."""
    key, asc, ascq = be(F.col("event_id") % 16, 1), be(F.col("user_id") % 256, 1), be(F.col("event_id") % 7, 1)
    fixed = F.concat(F.lit("7000"), key, F.lit("00" * 9), asc, ascq, F.lit("00000000"))
    told = F.concat(F.lit("72"), key, asc, ascq, F.lit("00000000"))
    raw = F.unhex(F.when(F.col("event_id") % 3 == 0, fixed).when(F.col("event_id") % 3 == 1, told).otherwise("70"))
    return table(spark, sf_dir, "events").select("event_id", telemetry.sense(raw).alias("x")).select("event_id", "x.*")


@query("""
    SELECT event_id, 1025 AS id, 1 AS format, TRUE AS read_only, event_type AS value FROM events
    UNION ALL SELECT event_id, 3, 0, FALSE, lpad(CAST(event_id % 10 AS VARCHAR), 2, '0') FROM events
""")
def cartridge_attributes(spark, sf_dir):
    """Cartridge memory attributes, the last of an id (B2)."""
    item = lambda code, flags, body: F.concat(be(code, 2), F.lit(flags), be(F.length(body) / 2, 2), body)
    name = F.hex(F.col("event_type").cast("binary"))
    body = F.concat(item(0x401, "01", F.lit("3F")), item(3, "00", F.hex(F.lpad((F.col("event_id") % 10).cast("string"), 2, "0").cast("binary"))), item(0x401, "81", name))
    rows = table(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(be(F.length(body) / 2, 4), body)).alias("raw"))
    return telemetry.attributes(rows, KEYS).select("event_id", "id", "format", "read_only", F.decode("value", "ISO-8859-1").alias("value"))


@query("""
    SELECT event_id, 0 AS ord, event_id % 256 AS index, 'AES-256-GCM' AS name, CAST(256 AS BIGINT) AS key_bits, event_id % 2 = 1 AS usable FROM events
    UNION ALL SELECT event_id, 1, 7, 'algorithm 0x0001' || lpad(lower(to_hex(user_id % 16 + 32)), 4, '0'), 128, FALSE FROM events
""")
def algorithms(spark, sf_dir):
    """Encryption algorithms of a drive; a torn descriptor ends the list."""
    item = lambda index, flags, size, code: F.concat(index, F.lit("000014"), flags, F.lit("00" * 5), be(size, 2), F.lit("00" * 8), code)
    usable = F.when(F.col("event_id") % 2 == 1, "82").otherwise("81")
    body = F.concat(F.lit("00" * 20), item(be(F.col("event_id") % 256, 1), usable, 32, F.lit("00010014")), item(F.lit("07"), F.lit("02"), 16, be(F.col("user_id") % 16 + 32 + 65536, 4)), F.lit("08000014"))
    return telemetry.algorithms(table(spark, sf_dir, "events").select("event_id", F.unhex(body).alias("raw")), KEYS).select("event_id", "ord", "index", "name", "key_bits", "usable")


@query("SELECT event_id, 0 AS ord, 'LTO-' || CASE event_id % 3 WHEN 0 THEN '5' WHEN 1 THEN '6' ELSE '7' END || CASE WHEN user_id % 2 = 0 THEN ' WORM' ELSE '' END AS format, event_id AS hours FROM events WHERE event_id > 0")
def head_hours(spark, sf_dir):
    """Hours by cartridge format, without empty and torn entries."""
    density = F.when(F.col("event_id") % 3 == 0, "58").when(F.col("event_id") % 3 == 1, "5A").otherwise("5C")
    body = F.concat(F.lit("0000"), density, F.when(F.col("user_id") % 2 == 0, "04").otherwise("00"), be(F.col("event_id"), 4), F.lit("0000580000000000"), F.lit("0000"))
    return telemetry.head_hours(params_of(spark, sf_dir, telemetry.DEVICE_STATS, param(0x1000, body)), KEYS)


@query("""
    SELECT event_id, event_id % 16 AS result, user_id % 100 AS hours, event_id % 16 = 0 AS passed,
           CASE event_id % 16 WHEN 0 THEN 'passed' WHEN 1 THEN 'aborted by a self-test abort request' WHEN 2 THEN 'aborted by another method' WHEN 3 THEN 'did not complete (unknown error)' WHEN 4 THEN 'failed, failing segment unknown'
                WHEN 15 THEN 'in progress' WHEN 5 THEN 'failed in segment 9' WHEN 6 THEN 'failed in segment 9' WHEN 7 THEN 'failed in segment 9' ELSE 'result code 0x' || lower(to_hex(event_id % 16)) END AS description FROM events
""")
def self_tests(spark, sf_dir):
    """The newest self-test result."""
    body = F.concat(be(F.col("event_id") % 16 + 32, 1), F.lit("09"), be(F.col("user_id") % 100, 2), F.lit("00" * 12))
    rows = telemetry.self_test(params_of(spark, sf_dir, telemetry.SELF_TEST, param(1, body)), KEYS)
    return rows.select("event_id", F.col("result").cast("long").alias("result"), "hours", "passed", "description")


@query("SELECT event_id, CAST(CASE WHEN event_id % 40 = 39 THEN 0 WHEN event_id % 40 < 24 THEN event_id % 40 ELSE -1 END AS INTEGER) AS boundary, user_id AS capacity FROM events")
def microcode_buffers(spark, sf_dir):
    """Alignment and size of a drive's download buffer."""
    code = F.when(F.col("event_id") % 40 == 39, 255).otherwise(F.col("event_id") % 40)
    rows = table(spark, sf_dir, "events").select("event_id", telemetry.microcode_buffer(F.unhex(F.concat(be(code, 1), be(F.col("user_id"), 3)))).alias("x"))
    return rows.select("event_id", "x.boundary", "x.capacity")


@query("SELECT event_id, event_type AS word, 'KEY' || lower(lpad(to_hex(event_id), 18, '0')) AS key_id, '2024-01-0' || (event_id % 9 + 1) || ' 12:34:56' AS build, lower(lpad(to_hex(user_id), 8, '0')) || '-0000-4000-8000-00000000abcd' AS volume_uuid FROM events")
def drive_texts(spark, sf_dir):
    """Text in drive bytes: EBCDIC, key ids, build times, volume UUIDs."""
    codes = {chr(ord(a) + i): f"{c + i:02X}" for c, a, n in ((0x81, "a", 9), (0x91, "j", 9), (0xA2, "s", 8)) for i in range(n)} | {"_": "6D"}
    of = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    letters = F.unhex(F.array_join(F.transform(F.split(F.regexp_replace("event_type", "[^a-z]", ""), ""), lambda c: F.coalesce(F.try_element_at(of, c), F.lit(""))), ""))
    key = F.unhex(F.concat(text("KEY", 3), be(F.col("event_id"), 9)))
    build = F.unhex(F.concat(F.lit("00" * 16), text("123456", 6), F.lit("00"), text(F.concat(F.lit("2024010"), (F.col("event_id") % 9 + 1).cast("string")), 8), F.lit("00" * 12)))
    uuid = F.concat(F.lower(be(F.col("user_id"), 4)), F.lit("-0000-4000-8000-00000000abcd"))
    coherency = F.unhex(F.concat(F.lit("04"), F.lit("00" * 4), F.lit("00" * 16), F.lit("002A"), text(F.concat(F.lit("LTFS\x00"), uuid, F.lit("\x00")), 42)))
    return table(spark, sf_dir, "events").select("event_id", scalars.ebcdic(letters).alias("word"), scalars.key_id(key).alias("key_id"), scalars.firmware_build(build).alias("build"), scalars.coherency_uuid(coherency).alias("volume_uuid"))


@query("""
    WITH w AS (SELECT user_id AS drive, ts, event_type, value > 95 AS dirty, CAST(floor(value) AS BIGINT) AS n, lag(event_type) OVER o AS was, row_number() OVER o AS rn, first_value(CAST(floor(value) AS BIGINT)) OVER o AS base,
                      coalesce(max(CASE WHEN value > 95 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS told FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, greatest(n - base, 0) AS rise FROM w),
    m AS (SELECT *, coalesce(max(rise) OVER (PARTITION BY drive ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM r)
    SELECT CAST(drive AS VARCHAR) AS drive, ts, 'cleaning' AS kind, 'drive requests cleaning' AS what, CAST(NULL AS VARCHAR) AS was, CASE WHEN rn = 1 THEN 'before' ELSE 'running' END AS now FROM m WHERE dirty AND told = 0
    UNION ALL SELECT CAST(drive AS VARCHAR), ts, 'link', 'port 1 phy 0', was, event_type FROM m WHERE was <> event_type
    UNION ALL SELECT CAST(drive AS VARCHAR), ts, 'errors', 'write', CAST(top AS VARCHAR), CAST(rise AS VARCHAR) FROM m WHERE rise > top
""")
def drive_watch(spark, sf_dir):
    """Events as polls of drives, one drive for each user, watched as a stream."""
    polls = drive_polls(table(spark, sf_dir, "events"))
    base = fresh_path(spark, "watch")
    polls.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(polls.schema).parquet(f"{base}/in")
    watch_drives(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def drive_polls(events):
    return events.select(
        F.col("user_id").cast("string").alias("drive"), "ts", F.when(F.col("value") > 95, "drive requests cleaning").otherwise("").alias("cleaning"),
        F.array(F.struct(F.lit("port 1 phy 0").alias("link"), F.col("event_type").alias("rate"))).alias("links"),
        F.floor("value").cast("long").alias("write_uncorrected"), F.lit(0).cast("long").alias("read_uncorrected"),
    )


@query("""
    SELECT event_id, CAST(k AS INTEGER) AS ord, CAST(CASE WHEN k = 0 THEN 88 ELSE 90 END AS BIGINT) AS primary_code, (event_id + k) % 2 = 0 AS writable, k = 1 AS is_default, event_id * 10 + k AS capacity_mb, 'LTO-CVE' AS organization,
           CASE WHEN k = 0 THEN 'U-516' ELSE 'U-616' END AS name, event_type AS description, CASE WHEN k = 0 THEN 'LTO-5' ELSE 'LTO-6' END AS generation FROM events, range(2) r(k)
""")
def densities(spark, sf_dir):
    """Density descriptors of a drive; a torn third one is left out."""
    one = lambda k, code, name: F.concat(
        F.lit(code * 2), be((((F.col("event_id") + k) % 2 == 0).cast("int") * 0x80) + 0x20 * k, 1), F.lit("00" * 9), be(F.col("event_id") * 10 + k, 4), text("LTO-CVE", 8), text(name, 8), text(F.col("event_type"), 20),
    )
    body = F.concat(one(0, "58", "U-516"), one(1, "5A", "U-616"), F.lit("5C5C00"))
    rows = table(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(be(F.length(body) / 2, 2), F.lit("0000"), body)).alias("raw"))
    return telemetry.densities(rows, KEYS).select("event_id", "ord", "primary_code", "writable", "is_default", "capacity_mb", "organization", "name", "description", "generation")


@query("SELECT event_id, CAST(2 AS BIGINT) AS encrypt_mode, event_id % 3 AS algorithm_index, user_id AS key_instance, event_type AS key, CASE event_id % 3 WHEN 1 THEN 'AES-256-GCM' WHEN 2 THEN 'algorithm 0x00010020' END AS algorithm FROM events")
def encryption_status(spark, sf_dir):
    """A drive's encryption as it is set, with its key and the algorithm's name."""
    name = F.hex(F.col("event_type").cast("binary"))
    key = F.concat(F.lit("0000"), be(F.length(name) / 2, 2), name)
    body = F.concat(F.lit("00" * 5), F.lit("02"), F.lit("03"), be(F.col("event_id") % 3, 1), be(F.col("user_id"), 4), F.lit("00" * 12), F.lit("02000001FF"), key)
    e = table(spark, sf_dir, "events")
    status = telemetry.encryption_status(e.select("event_id", F.unhex(body).alias("raw")), KEYS)
    known = [(0, 1, "AES-256-GCM"), (1, 2, "algorithm 0x00010020"), (2, 1, "later")]
    listed = F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(i).cast("long").alias("index"), F.lit(n).alias("name")) for o, i, n in known))
    algos = e.select("event_id", F.inline(listed))
    return telemetry.current_algorithm(status, algos, KEYS).select("event_id", "encrypt_mode", "algorithm_index", "key_instance", F.decode("key_raw", "ISO-8859-1").alias("key"), "algorithm")


@query("""
    SELECT event_id, 'SN' || user_id AS serial, event_id % 2 = 1 AS idle_enabled, event_id % 4 >= 2 AS standby_enabled, user_id * 100 AS idle_ms, event_id % 3 = 0 AS compressing FROM events
""")
def drive_modes(spark, sf_dir):
    """Serial number, power timers and compression of a drive's pages."""
    serial = text(F.concat(F.lit("SN"), F.col("user_id").cast("string")), 12)
    power = F.concat(F.lit("00000008"), F.lit("00" * 8), F.lit("1A26"), F.lit("00"), be(F.when(F.col("event_id") % 2 == 1, 2).otherwise(0) + F.when(F.col("event_id") % 4 >= 2, 1).otherwise(0), 1), be(F.col("user_id"), 4), be(0, 4))
    mode = F.concat(F.lit("00000000"), F.lit("0F0E"), F.when(F.col("event_id") % 3 == 0, "80").otherwise("00"), F.lit("00"))
    rows = table(spark, sf_dir, "events").select("event_id", telemetry.serial_number(F.unhex(F.concat(F.lit("0180000C"), serial))).alias("serial"), telemetry.power_condition(F.unhex(power)).alias("p"), telemetry.compression_mode(F.unhex(mode)).alias("compressing"))
    return rows.select("event_id", "serial", "p.idle_enabled", "p.standby_enabled", "p.idle_ms", "compressing")


@query("""
    SELECT event_id, concat_ws('; ', CASE WHEN event_id % 2 = 1 THEN 'drive requests cleaning' END, 'TapeAlert 3 (warning): hard error: read or write failed',
           CASE WHEN user_id % 3 > 0 THEN 'drive reports ' || (user_id % 3) || ' uncorrected write errors' END, CASE WHEN event_id % 5 = 0 THEN 'drive mechanism has exceeded its maximum recommended temperature' END) AS warnings,
           CASE WHEN event_id % 7 = 0 THEN 'read' ELSE '' END AS problems FROM events
""")
def drive_warnings(spark, sf_dir):
    """What needs attention in a drive's snapshot, in fixed order, and the parts missing."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("decimal(20,0)")
    parts = {
        "status": e.select("event_id", F.when(F.col("event_id") % 2 == 1, "drive requests cleaning").alias("cleaning")), "write": e.select("event_id", (F.col("user_id") % 3).cast("decimal(20,0)").alias("uncorrected")),
        "read": e.where("event_id % 7 <> 0").select("event_id", F.lit(0).cast("decimal(20,0)").alias("uncorrected")), "non_medium": e.select("event_id", none.alias("non_medium")),
        "stats": e.select("event_id", (F.col("event_id") % 5 == 0).alias("temperature_exceeded")), "volume": e.select("event_id", none.alias("write_unrecovered"), none.alias("read_unrecovered"), F.lit(False).alias("temperature_exceeded")),
        "loaded": e.select("event_id", F.lit(0).cast("long").alias("n")),
    }
    info = telemetry.gather(parts, KEYS)
    alerts = e.select("event_id", F.lit(3).alias("flag"), F.lit("hard error: read or write failed").alias("name"), F.lit("warning").alias("severity")).unionByName(e.select("event_id", F.lit(11).alias("flag"), F.lit("cleaning cartridge loaded").alias("name"), F.lit("info").alias("severity")))
    told = telemetry.warnings(info, KEYS, alerts).join(info.select("event_id", "problems"), "event_id")
    return told.select("event_id", F.array_join("warnings", "; ").alias("warnings"), F.array_join("problems", ",").alias("problems"))


@query("SELECT user_id % 10 AS drive, count(*) AS n FROM events WHERE value > 50 AND user_id = user_id % 10 + 10 GROUP BY 1")
def loaded_errors(spark, sf_dir):
    """Errors that a drive's history holds for the cartridge it has loaded."""
    e = table(spark, sf_dir, "events")
    log = e.select((F.col("user_id") % 10).alias("drive"), F.when(F.col("value") > 50, 3).otherwise(4).alias("key"), F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("medium_id"))
    loaded = spark.range(10).select(F.col("id").alias("drive"), F.concat(F.lit("M"), (F.col("id") + 10).cast("string")).alias("serial"))
    return telemetry.loaded_errors(log, loaded, ["drive"])
