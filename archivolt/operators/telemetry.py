"""Captured drive bytes: log pages, cartridge attributes, sense data, snapshots, warnings, error-log analysis.

Pages are rows of (keys.., raw). Their parameters are cut out by an Arrow UDF that returns an array, exploded; what
follows is columns and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import lookups as L
from archivolt.functions.scalars import be_int, be_uint, cleaning_warning, coherency_uuid, mega_and_bytes, printable

PARAMS = "array<struct<code:int,value:binary>>"
# Log page codes.
WRITE_ERRORS, READ_ERRORS, NON_MEDIUM, SEQUENTIAL, SELF_TEST, DEVICE_STATUS, DEVICE_STATS, DIAGNOSTICS, VOLUME_STATS, PROTOCOL_PORT, COMPRESSION, TAPE_ALERT = 0x02, 0x03, 0x06, 0x0C, 0x10, 0x11, 0x14, 0x16, 0x17, 0x18, 0x1B, 0x2E


def cut(raw: bytes | None, head: int, width: int, end: int) -> list[dict]:
    """Parameters that lie whole before end: a two-byte code, a flag byte and a length of `width` bytes, then the value."""
    out, at = [], head
    while raw is not None and at + 3 + width <= end:
        size = int.from_bytes(raw[at + 3 : at + 3 + width])
        body = at + 3 + width
        if body + size > end:
            break
        out.append({"code": int.from_bytes(raw[at : at + 2]), "flags": raw[at + 2], "value": bytes(raw[body : body + size])})
        at = body + size
    return out


def log_page(raw: bytes | None) -> list[dict]:
    """A log page's parameters; the page's length counts only as far as bytes were received, a torn last one is dropped."""
    if raw is None or len(raw) < 4:
        return []
    return cut(raw, 4, 1, min(len(raw), 4 + int.from_bytes(raw[2:4])))


def attribute_list(raw: bytes | None) -> list[dict]:
    """Cartridge memory attributes: as log parameters, with two-byte lengths."""
    if raw is None or len(raw) < 4:
        return []
    return cut(raw, 4, 2, min(len(raw), 4 + int.from_bytes(raw[:4])))


def log_params(pages: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, page, ord, code, value. Pages shorter than 4 bytes give nothing."""
    of = F.udf(log_page, PARAMS, useArrow=True)
    rows = pages.select(*keys, (be_int(F.col(raw), 0, 1) % 64).cast("int").alias("page"), F.posexplode(of(raw)).alias("ord", "p"))
    return rows.select(*keys, "page", "ord", "p.code", "p.value")


def attributes(pages: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, id, read_only, format, value: the last of each id wins."""
    of = F.udf(attribute_list, "array<struct<code:int,flags:int,value:binary>>", useArrow=True)
    rows = pages.select(*keys, F.posexplode(of(raw)).alias("ord", "p")).select(*keys, "ord", F.col("p.code").alias("id"), ((F.col("p.flags") >= 128)).alias("read_only"), (F.col("p.flags") % 4).alias("format"), "p.value")
    return rows.groupBy(*keys, "id").agg(F.max_by(F.struct("read_only", "format", "value"), "ord").alias("x")).select(*keys, "id", "x.*")


def first_values(params: DataFrame, keys: list[str], page: int, codes: dict[str, int]) -> DataFrame:
    """keys, and a column of the first value (binary) of each named code of a page; null where it isn't reported."""
    own = params.where(F.col("page") == page)
    return own.groupBy(*keys).agg(*(F.min_by(F.when(F.col("code") == c, F.col("value")), F.when(F.col("code") == c, F.col("ord"))).alias(n) for n, c in codes.items()))


def counts(params: DataFrame, keys: list[str], page: int, codes: dict[str, int]) -> DataFrame:
    """As first_values(), as decimal(20,0). 0 is a count; null means not reported."""
    found = first_values(params, keys, page, codes)
    return found.select(*keys, *(be_uint(F.col(n)).alias(n) for n in codes))


def error_counters(params: DataFrame, keys: list[str], page: int) -> DataFrame:
    return counts(params, keys, page, {"corrected": 0x0003, "bytes": 0x0005, "uncorrected": 0x0006})


def counter_snapshots(params: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the five error counters of a poll."""
    w = error_counters(params, keys, WRITE_ERRORS).select(*keys, F.col("corrected").alias("write_corrected"), F.col("uncorrected").alias("write_uncorrected"))
    r = error_counters(params, keys, READ_ERRORS).select(*keys, F.col("corrected").alias("read_corrected"), F.col("uncorrected").alias("read_uncorrected"))
    return w.join(r, keys, "full").join(counts(params, keys, NON_MEDIUM, {"non_medium": 0x0000}), keys, "full")


def bit(raw: Column, at: int, mask: int) -> Column:
    return be_int(raw, at, 1).bitwiseAND(mask) != 0


def device_status(params: DataFrame, keys: list[str]) -> DataFrame:
    """The status bits, the activity and the cleaning warning of each device status page."""
    v = F.col("v")
    rows = first_values(params, keys, DEVICE_STATUS, {"v": 0x0000}).where(F.octet_length("v") >= 4)
    flags = {"clean_requested": (0, 0x04), "clean_required": (0, 0x02), "write_protect": (0, 0x08), "compression": (0, 0x10), "in_transition": (1, 0x80), "medium_present": (1, 0x10), "threaded": (1, 0x02), "mounted": (1, 0x01)}
    rows = rows.select(*keys, *(bit(v, a, m).alias(n) for n, (a, m) in flags.items()), be_int(v, 2, 1).cast("int").alias("code"))
    return rows.withColumn("activity", L.name_of(F.col("code"), L.ACTIVITIES, L.hex_name("activity", F.col("code")))).withColumn("cleaning", cleaning_warning(F.col("clean_required"), F.col("clean_requested"))).drop("code")


def tape_alerts(params: DataFrame, keys: list[str]) -> DataFrame:
    """keys, flag, name, severity of the flags that are set, 1 to 64."""
    rows = params.where((F.col("page") == TAPE_ALERT) & F.col("code").between(1, 64) & (F.octet_length("value") >= 1)).where(bit(F.col("value"), 0, 1))
    names, kinds = {k: n for k, (n, _) in L.TAPE_ALERTS.items()}, {k: L.SEVERITIES[s] for k, (_, s) in L.TAPE_ALERTS.items()}
    flag = F.col("code")
    return rows.select(*keys, flag.alias("flag"), L.name_of(flag, names, F.concat(F.lit("TapeAlert flag "), flag.cast("string"))).alias("name"), L.name_of(flag, kinds, F.lit("warning")).alias("severity"))


def phys(value: bytes | None) -> list[dict]:
    """(phy, rate code) of each SAS descriptor; one that doesn't fit ends the port."""
    out, at = [], 4
    if value is None or len(value) < 4 or value[0] & 0x0F != 6:
        return out
    for _ in range(value[3]):
        if at + 6 > len(value):
            break
        size = value[at + 3] + 4
        if size < 6 or at + size > len(value):
            break
        out.append({"phy": value[at + 1], "rate": value[at + 5] & 0x0F})
        at += size
    return out


def link_rates(params: DataFrame, keys: list[str]) -> DataFrame:
    """keys, port, phy, link ('port p phy n') and rate of each SAS phy."""
    of = F.udf(phys, "array<struct<phy:int,rate:int>>", useArrow=True)
    rows = params.where(F.col("page") == PROTOCOL_PORT).select(*keys, F.col("code").alias("port"), F.explode(of("value")).alias("x"))
    rate = L.name_of(F.col("x.rate"), L.LINK_RATES, F.concat(F.lit("rate 0x"), F.lower(F.hex(F.col("x.rate").cast("long")))))
    return rows.select(*keys, "port", F.col("x.phy").alias("phy"), F.format_string("port %d phy %d", "port", "x.phy").alias("link"), rate.alias("rate"))


DRIVE_STATS = {"loads": 0x0000, "cleanings": 0x0001, "power_on_hours": 0x0002, "head_hours": 0x0003, "meters_of_tape": 0x0004, "hours_since_cleaning": 0x0008, "power_cycles": 0x000C, "hard_write_errors": 0x000E, "hard_read_errors": 0x000F, "temperature": 0x0081}
VOLUME_COUNTS = {"mounts": 0x0001, "passes": 0x0101, "write_retries": 0x0003, "write_unrecovered": 0x0004, "read_retries": 0x0008, "read_unrecovered": 0x0009, "last_write_unrecovered": 0x000C, "last_read_unrecovered": 0x000D, "last_mb_written": 0x000E, "last_mb_read": 0x000F, "native_capacity_mb": 0x0016, "used_native_mb": 0x0017, "temperature": 0x0082}


def _temperature(rows: DataFrame) -> DataFrame:
    return rows.withColumn("temperature_exceeded", F.coalesce(F.col("temperature") != 0, F.lit(False))).drop("temperature")


def drive_stats(params: DataFrame, keys: list[str]) -> DataFrame:
    return _temperature(counts(params, keys, DEVICE_STATS, DRIVE_STATS))


def strides(value: Column, width: int, skip: int = 0) -> Column:
    """An array of the whole pieces of `width` bytes of a value after its first `skip`."""
    n = F.floor((F.octet_length(value) - skip) / width).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(value, i * width + skip + 1, F.lit(width)))


def head_hours(params: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, format, hours: hours by cartridge format; torn and zero entries are left out."""
    first = first_values(params, keys, DEVICE_STATS, {"v": 0x1000})
    d = F.col("d")
    rows = first.select(*keys, F.posexplode(strides(F.col("v"), 8)).alias("ord", "d")).withColumn("hours", be_int(d, 4, 4)).where("hours > 0")
    return rows.select(*keys, "ord", L.density_name(be_int(d, 2, 1).cast("int"), bit(d, 3, 0x04)).alias("format"), "hours")


def compression(params: DataFrame, keys: list[str]) -> DataFrame:
    c = counts(params, keys, COMPRESSION, {"enabled": 0x0100, "read_ratio": 0x0000, "write_ratio": 0x0001, **{f"x{i}": i for i in range(2, 10)}})
    pair = lambda i: mega_and_bytes(F.col(f"x{i}"), F.col(f"x{i + 1}"))
    return c.select(*keys, "enabled", "read_ratio", "write_ratio", pair(2).alias("to_host"), pair(4).alias("from_tape"), pair(6).alias("from_host"), pair(8).alias("to_tape"))


def volume_stats(params: DataFrame, keys: list[str]) -> DataFrame:
    """A cartridge's statistics; only of pages that report mounts or write retries."""
    raw = first_values(params, keys, VOLUME_STATS, VOLUME_COUNTS).where("mounts is not null or write_retries is not null")
    return _temperature(raw.select(*keys, *(be_uint(F.col(n)).alias(n) for n in VOLUME_COUNTS)))


def cartridge(attrs: DataFrame, keys: list[str]) -> DataFrame:
    """A cartridge's identity and capacity from its attributes."""
    codes = {"remaining_mib": 0x0000, "capacity_mib": 0x0001, "loads": 0x0003, "written_mib": 0x0220, "read_mib": 0x0221}
    texts = {"manufacturer": 0x0400, "serial": 0x0401, "manufactured": 0x0406, "app_vendor": 0x0800, "app_name": 0x0801, "app_version": 0x0802, "label": 0x0803, "barcode": 0x0806}
    at = lambda c: F.max(F.when(F.col("id") == c, F.col("value")))
    rows = attrs.groupBy(*keys).agg(*(at(c).alias(n) for n, c in {**codes, **texts, "density": 0x0405, "kind": 0x0408, "coherency": 0x080C}.items()))
    one = lambda n: F.when(F.octet_length(n) == 1, be_int(F.col(n), 0, 1).cast("int"))
    return rows.select(
        *keys, *(be_uint(F.col(n)).alias(n) for n in codes), *(F.coalesce(printable(F.col(n)), F.lit("")).alias(n) for n in texts),
        L.name_of(one("density"), L.DENSITIES, L.hex_name("density", one("density"))).alias("format"), L.name_of(one("kind"), L.MEDIUM_KINDS, L.hex_name("type", one("kind"))).alias("kind"), coherency_uuid(F.col("coherency")).alias("volume_uuid"),
    )


def error_log(params: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries of the drive's error history in its order, keys with slots): slots of 68 bytes at least; unused ones aren't entries."""
    b = F.col("value")
    rows = params.where((F.col("page") == DIAGNOSTICS) & (F.octet_length("value") >= 68))
    slots = rows.groupBy(*keys).agg(F.count("*").alias("slots"))
    density = be_int(b, 2, 1).cast("int")
    out = rows.select(
        *keys, "ord", F.col("code").alias("slot"), F.when(density.isin(*L.DENSITIES), L.density_name(density, bit(b, 3, 0x04))).otherwise("").alias("format"), bit(b, 9, 0x80).alias("repeated"), (be_int(b, 9, 1) % 16).cast("int").alias("key"),
        be_int(b, 10, 1).cast("int").alias("asc"), be_int(b, 11, 1).cast("int").alias("ascq"), be_int(b, 12, 4).alias("vendor_code"), printable(F.substring(b, 17, 4)).alias("firmware"), be_int(b, 20, 4).alias("clean_hours"),
        be_int(b, 24, 1).cast("int").alias("op"), printable(F.substring(b, 29, 32)).alias("medium_id"), (be_int(b, 60, 1) % 8).cast("int").alias("origin"), be_int(b, 62, 6).alias("timestamp_ms"), be_int(b, 4, 4).alias("motion_hours"),
    )
    used = ~((F.col("key") == 0) & (F.col("asc") == 0) & (F.col("ascq") == 0) & (F.col("medium_id") == "") & (F.col("vendor_code") == 0))
    out = out.where(used).withColumn("description", L.error_description(F.col("key"), F.col("asc"), F.col("ascq"))).withColumn("operation", L.operation_name(F.col("op"))).withColumn("happened", L.error_time(F.col("timestamp_ms"), F.col("origin")))
    return out, slots


def medium_errors(log: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """keys, medium, errors, kinds: medium errors per cartridge, their kinds in the order first seen."""
    kind = L.sense_text(F.col("asc"), F.col("ascq"))
    rows = log.where("key = 3").select(*keys, F.coalesce(F.nullif(F.col("medium_id"), F.lit("")), F.lit("unknown cartridge")).alias("medium"), F.struct(F.col(order).alias("at"), kind.alias("kind")).alias("x"))
    per_kind = rows.groupBy(*keys, "medium", "x.kind").agg(F.count("*").alias("n"), F.min("x.at").alias("at"))
    seen = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("at", "kind")))), lambda s: s["kind"])
    return per_kind.groupBy(*keys, "medium").agg(F.sum("n").alias("errors"), seen.alias("kinds"))


def analyse_errors(log: DataFrame, keys: list[str], current: str, order: str = "ord") -> DataFrame:
    """Per group: media with medium errors, whether three or more of them point to the drive, hardware errors, entries of older firmware."""
    older = (F.col("firmware") != "") & (F.col("firmware") != current) & F.lit(current != "")
    media = medium_errors(log, keys, order).groupBy(*keys).agg(F.count("*").alias("media"), F.sum("errors").alias("medium_errors"))
    rest = log.groupBy(*keys).agg(F.count_if(F.col("key") == 4).alias("hardware_errors"), F.count_if(older).alias("older_entries"), F.array_sort(F.collect_set(F.when(older, F.col("firmware")))).alias("older_levels"))
    out = rest.join(media, keys, "left")
    return out.select(*keys, F.coalesce("media", F.lit(0)).alias("media"), F.coalesce("medium_errors", F.lit(0)).alias("medium_errors"), (F.coalesce("media", F.lit(0)) >= 3).alias("drive_suspected"), "hardware_errors", "older_entries", "older_levels")


def loaded_errors(log: DataFrame, cartridges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: medium errors that the log holds for the loaded cartridge."""
    mine = cartridges.where("serial <> ''").select(*keys, F.col("serial").alias("medium_id"))
    return log.where("key = 3").join(mine, [*keys, "medium_id"], "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))


def densities(pages: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, ord and the fields of each 52-byte density descriptor."""
    b = F.substring(F.col(raw), F.lit(1), F.least(be_int(F.col(raw), 0, 2) + 4, F.octet_length(raw)).cast("int"))
    d = F.col("d")
    rows = pages.where(F.octet_length(raw) >= 4).select(*keys, F.posexplode(strides(b, 52, 4)).alias("ord", "d"))
    return rows.select(
        *keys, "ord", be_int(d, 0, 1).alias("primary_code"), be_int(d, 1, 1).alias("secondary_code"), bit(d, 2, 0x80).alias("writable"), bit(d, 2, 0x40).alias("duplicate"), bit(d, 2, 0x20).alias("is_default"), be_int(d, 12, 4).alias("capacity_mb"),
        printable(F.substring(d, 17, 8)).alias("organization"), printable(F.substring(d, 25, 8)).alias("name"), printable(F.substring(d, 33, 20)).alias("description"), L.name_of(be_int(d, 0, 1).cast("int"), L.DENSITIES, F.lit("")).alias("generation"),
    )


def _security(raw: bytes | None, at: int, least: int) -> list[bytes]:
    """Descriptors with a four-byte head whose last two bytes are the length of the rest; a short or torn one ends the list."""
    out = []
    while raw is not None and at + 4 <= len(raw):
        n = int.from_bytes(raw[at + 2 : at + 4])
        if n < least or at + 4 + n > len(raw):
            break
        out.append(bytes(raw[at : at + 4 + n]))
        at += 4 + n
    return out


def algorithms(pages: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, ord, index, code, name, key_bits, usable of each encryption algorithm."""
    of = F.udf(lambda b: _security(b, 20, 20), "array<binary>", useArrow=True)
    d = F.col("d")
    rows = pages.select(*keys, F.posexplode(of(raw)).alias("ord", "d"))
    code = be_int(d, 20, 4)
    return rows.select(*keys, "ord", be_int(d, 0, 1).alias("index"), code.alias("code"), F.when(code == 0x00010014, "AES-256-GCM").otherwise(L.hex_name("algorithm", code, 8)).alias("name"), (be_int(d, 10, 2) * 8).alias("key_bits"), ((be_int(d, 4, 1) % 4 == 2) & bit(d, 4, 0x80)).alias("usable"))


def encryption_status(pages: DataFrame, keys: list[str], raw: str = "raw", kinds: tuple[int, int] = (0, 1)) -> DataFrame:
    """keys, the modes, algorithm index, key instance and key_raw: the first key descriptor of the given kinds."""
    of = F.udf(lambda b: next((x[4:] for x in _security(b, 24, 0) if x[0] in kinds), None), "binary", useArrow=True)
    b = F.col(raw)
    rows = pages.where(F.octet_length(raw) >= 24)
    return rows.select(*keys, be_int(b, 5, 1).alias("encrypt_mode"), be_int(b, 6, 1).alias("decrypt_mode"), be_int(b, 7, 1).alias("algorithm_index"), be_int(b, 8, 4).alias("key_instance"), of(raw).alias("key_raw"))


def current_algorithm(status: DataFrame, algos: DataFrame, keys: list[str]) -> DataFrame:
    """status with `algorithm`: the first listed with its index."""
    first = algos.groupBy(*keys, F.col("index").alias("algorithm_index")).agg(F.min_by("name", "ord").alias("algorithm"))
    return status.join(first, [*keys, "algorithm_index"], "left")


def inquiry(raw: Column) -> Column:
    """device_type, vendor, product, revision; null below 36 bytes."""
    made = F.struct((be_int(raw, 0, 1) % 32).alias("device_type"), printable(F.substring(raw, 9, 8)).alias("vendor"), printable(F.substring(raw, 17, 16)).alias("product"), printable(F.substring(raw, 33, 4)).alias("revision"))
    return F.when(F.octet_length(raw) >= 36, made)


def serial_number(raw: Column) -> Column:
    n = F.least(be_int(raw, 3, 1), F.octet_length(raw) - 4).cast("int")
    return F.when((F.octet_length(raw) >= 4) & (be_int(raw, 1, 1) == 0x80), printable(F.substring(raw, F.lit(5), n)))


def power_condition(raw: Column) -> Column:
    """Idle and standby timers in ms (100 ms units) of a power mode page behind its header and block descriptors."""
    at = (be_int(raw, 3, 1) + 4).cast("int")
    byte = lambda i, n=1: F.conv(F.hex(F.substring(raw, at + i + 1, F.lit(n))), 16, 10).cast("long")
    made = F.struct((byte(3).bitwiseAND(2) != 0).alias("idle_enabled"), (byte(3).bitwiseAND(1) != 0).alias("standby_enabled"), (byte(4, 4) * 100).alias("idle_ms"), (byte(8, 4) * 100).alias("standby_ms"), (byte(1) >= 0x26).alias("extended"))
    return F.when((F.octet_length(raw) >= 4) & (at + 12 <= F.octet_length(raw)) & (byte(0) % 64 == 0x1A), made)


def compression_mode(raw: Column) -> Column:
    """Whether a data compression mode page says that the drive compresses; null if it isn't one."""
    at = (be_int(raw, 3, 1) + 4).cast("int")
    byte = lambda i: F.conv(F.hex(F.substring(raw, at + i + 1, F.lit(1))), 16, 10).cast("long")
    return F.when((F.octet_length(raw) >= 4) & (at + 3 <= F.octet_length(raw)) & (byte(0) % 64 == 0x0F), byte(2) >= 128)


def self_test(params: DataFrame, keys: list[str]) -> DataFrame:
    """The newest self-test result: function, result, segment, hours, sense, passed, in_progress, description."""
    v = F.col("v")
    rows = first_values(params, keys, SELF_TEST, {"v": 0x0001}).where(F.octet_length("v") >= 15)
    result, segment = (be_int(v, 0, 1) % 16).cast("int"), be_int(v, 1, 1)
    told = F.when(result.isin(5, 6, 7), F.format_string("failed in segment %d", segment)).otherwise(L.name_of(result, L.SELF_TESTS, L.hex_name("result code", result, 1)))
    return rows.select(*keys, F.floor(be_int(v, 0, 1) / 32).alias("function"), result.alias("result"), segment.alias("segment"), be_int(v, 2, 2).alias("hours"), (be_int(v, 12, 1) % 16).alias("key"), be_int(v, 13, 1).alias("asc"), be_int(v, 14, 1).alias("ascq"), (result == 0).alias("passed"), (result == 15).alias("in_progress"), told.alias("description"))


def sense(raw: Column) -> Column:
    """key, asc, ascq of sense data, fixed (0x70, 0x71) or descriptor (0x72, 0x73) format; what is too short counts as 0."""
    kind = be_int(raw, 0, 1) % 128
    size = F.octet_length(raw)
    fixed, described = kind.isin(0x70, 0x71), kind.isin(0x72, 0x73) & (size > 3)
    zero = F.lit(0).cast("long")
    pick = lambda a, a_ok, b: F.when(fixed & a_ok, a).when(described, b).otherwise(zero)
    return F.struct(pick(be_int(raw, 2, 1) % 16, size > 2, be_int(raw, 1, 1) % 16).alias("key"), pick(be_int(raw, 12, 1), size > 13, be_int(raw, 2, 1)).alias("asc"), pick(be_int(raw, 13, 1), size > 13, be_int(raw, 3, 1)).alias("ascq"))


def gather(parts: dict[str, DataFrame], keys: list[str], expected: list[str] | None = None) -> DataFrame:
    """One row per group with each part as a struct column (null where it is missing), and `problems`: the parts missing of those expected."""
    out = None
    for name, df in parts.items():
        packed = df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))
        out = packed if out is None else out.join(packed, keys, "full")
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in expected or parts)))
    return out.withColumn("problems", missing)


def warnings(info: DataFrame, keys: list[str], alerts: DataFrame) -> DataFrame:
    """keys, warnings: what needs attention, in fixed order. info: gather() of status, write, read, non_medium, stats, volume and loaded."""
    heard = alerts.where("severity <> 'info'").withColumn("text", F.concat(F.lit("TapeAlert "), F.col("flag").cast("string"), F.lit(" ("), "severity", F.lit("): "), "name"))
    heard = heard.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("flag", "text"))), lambda x: x["text"]).alias("alerts"))
    told = lambda c, text: F.when(c > 0, F.format_string(text, c.cast("long")))
    life = (F.coalesce("volume.write_unrecovered", F.lit(0)) > 0) | (F.coalesce("volume.read_unrecovered", F.lit(0)) > 0)
    first = F.array_compact(F.array(F.col("status.cleaning")))
    rest = F.array_compact(F.array(
        told(F.col("write.uncorrected"), "drive reports %d uncorrected write errors"), told(F.col("read.uncorrected"), "drive reports %d uncorrected read errors"), told(F.col("non_medium.non_medium"), "drive reports %d non-medium errors"),
        F.when(F.col("stats.temperature_exceeded"), "drive mechanism has exceeded its maximum recommended temperature"), told(F.col("loaded.n"), "the drive's error log has %d medium error(s) for the loaded cartridge"),
        F.when(life, F.format_string("tape has had %d unrecovered write and %d unrecovered read errors over its life", F.coalesce("volume.write_unrecovered", F.lit(0)).cast("long"), F.coalesce("volume.read_unrecovered", F.lit(0)).cast("long"))),
        F.when(F.col("volume.temperature_exceeded"), "tape has exceeded its maximum recommended temperature"),
    ))
    return info.join(heard, keys, "left").select(*keys, F.concat(first, F.coalesce("alerts", F.array().cast("array<string>")), rest).alias("warnings"))


def new_errors(rows: DataFrame) -> Column:
    """Messages for the counters that rose, the most serious first, from the columns <counter>_since."""
    kinds = [("write_uncorrected", "uncorrected write errors"), ("read_uncorrected", "uncorrected read errors"), ("non_medium", "non-medium errors"), ("write_corrected", "corrected write errors"), ("read_corrected", "corrected read errors")]
    return F.array_compact(F.array(*(F.when(F.col(f"{c}_since") > 0, F.concat(F.lit(f"{told} during this operation: "), F.col(f"{c}_since").cast("string"))) for c, told in kinds)))


def microcode_buffer(raw: Column) -> Column:
    """boundary (power of two that download offsets align to, -1 if undefined) and capacity of a buffer descriptor."""
    code = be_int(raw, 0, 1)
    made = F.struct(F.when(code == 0xFF, 0).when(code < 24, code).otherwise(-1).cast("int").alias("boundary"), be_int(raw, 1, 3).alias("capacity"))
    return F.when(F.octet_length(raw) >= 4, made)
