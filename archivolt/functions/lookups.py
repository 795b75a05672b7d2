"""Code names as small maps, looked up in columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and severities are those of the SCSI standards (SPC, SSC, SPL) and drive manuals; the words for them are what
# reports have to say, letter for letter.
DENSITIES = {0x40: "LTO-1", 0x42: "LTO-2", 0x44: "LTO-3", 0x46: "LTO-4", 0x58: "LTO-5", 0x5A: "LTO-6", 0x5C: "LTO-7", 0x5D: "LTO-7 Type M (M8)", 0x5E: "LTO-8", 0x60: "LTO-9"}
ACTIVITIES = {
    0x00: "idle", 0x01: "cleaning", 0x02: "loading", 0x03: "unloading", 0x04: "other medium activity", 0x05: "reading", 0x06: "writing", 0x07: "locating",
    0x08: "rewinding", 0x09: "erasing", 0x0A: "formatting", 0x0B: "calibrating", 0x0C: "other activity", 0x0D: "updating microcode", 0x0E: "reading encrypted data", 0x0F: "writing encrypted data",
}
LINK_RATES = {
    0x0: "unknown rate", 0x1: "disabled", 0x2: "reset problem", 0x3: "spinup hold", 0x4: "port selector", 0x5: "reset in progress", 0x6: "unsupported phy attached",
    0x8: "1.5 Gbps", 0x9: "3 Gbps", 0xA: "6 Gbps", 0xB: "12 Gbps", 0xC: "22.5 Gbps",
}
SENSE_KEYS = dict(enumerate(["no sense", "recovered error", "not ready", "medium error", "hardware error", "illegal request", "unit attention", "data protect", "blank check", "vendor specific", "copy aborted", "aborted command", "reserved", "volume overflow", "miscompare", "completed"]))
SENSE_CODES = {
    0x0300: "write fault", 0x0401: "becoming ready", 0x0402: "load needed", 0x0412: "drive offline", 0x0900: "track following error", 0x0C00: "write error",
    0x1100: "unrecovered read error", 0x1400: "recorded data not found", 0x1500: "positioning error", 0x2000: "invalid command", 0x2400: "invalid field in command",
    0x2600: "invalid field in parameter list", 0x2700: "write protected", 0x2800: "cartridge changed", 0x2900: "reset occurred", 0x3000: "incompatible cartridge",
    0x3003: "cleaning cartridge installed", 0x3100: "medium format corrupted", 0x3A00: "no cartridge", 0x3B00: "sequential positioning error", 0x3B0E: "medium source element empty",
    0x4400: "internal target failure", 0x5100: "erase failure", 0x5200: "cartridge fault", 0x5300: "cartridge load or eject failed", 0x5302: "medium removal prevented", 0x5500: "system resource failure",
}
OPERATIONS = {
    0x00: "test unit ready", 0x01: "rewind", 0x04: "format", 0x08: "read", 0x0A: "write", 0x10: "write filemarks", 0x11: "space", 0x19: "erase", 0x1B: "load/unload", 0x2B: "locate",
    0x34: "read position", 0x3B: "write buffer", 0x3C: "read buffer", 0x4D: "log sense", 0x8C: "read attribute", 0x8D: "write attribute", 0x91: "space", 0x92: "locate", 0xA2: "security protocol in", 0xB5: "security protocol out",
}
SELF_TESTS = {0x0: "passed", 0x1: "aborted by a self-test abort request", 0x2: "aborted by another method", 0x3: "did not complete (unknown error)", 0x4: "failed, failing segment unknown", 0xF: "in progress"}
MEDIUM_KINDS = {0x00: "data", 0x01: "cleaning", 0x80: "WORM"}
#: TapeAlert flag -> (name, severity: I info, W warning, C critical)
TAPE_ALERTS = {
    1: ("read warning: drive has trouble reading", "W"), 2: ("write warning: drive has trouble writing", "W"), 3: ("hard error: read or write failed", "W"), 4: ("media: data on the cartridge is at risk", "C"),
    5: ("read failure", "C"), 6: ("write failure", "C"), 7: ("media life: cartridge has reached its end of life", "W"), 8: ("cartridge is not data grade", "W"), 9: ("cartridge is write protected", "C"),
    10: ("cartridge removal prevented", "I"), 11: ("cleaning cartridge loaded", "I"), 12: ("unsupported cartridge format", "I"), 13: ("recoverable mechanical cartridge failure", "C"),
    14: ("unrecoverable mechanical cartridge failure", "C"), 15: ("cartridge memory chip failure", "W"), 16: ("cartridge was forcibly ejected", "C"), 17: ("read-only cartridge format", "W"),
    18: ("tape directory corrupted on load", "W"), 19: ("cartridge is nearing end of life", "I"), 20: ("clean now: drive needs cleaning", "C"), 21: ("clean periodic: drive is due for routine cleaning", "W"),
    22: ("cleaning cartridge is expired", "C"), 23: ("invalid cleaning cartridge", "C"), 24: ("retension requested", "W"), 25: ("dual-port interface error", "W"), 26: ("cooling fan failure", "W"),
    27: ("power supply failure", "W"), 28: ("power consumption out of range", "W"), 29: ("drive needs preventive maintenance", "W"), 30: ("drive hardware failure (A)", "C"), 31: ("drive hardware failure (B)", "C"),
    32: ("host interface problem", "W"), 33: ("eject cartridge and retry", "C"), 34: ("firmware download failed", "W"), 35: ("drive humidity out of range", "W"), 36: ("drive temperature out of range", "W"),
    37: ("drive voltage out of range", "W"), 38: ("predictive failure of drive hardware", "C"), 39: ("drive needs diagnostics", "W"), 49: ("lost statistics", "W"), 50: ("tape directory invalid at unload", "W"),
    51: ("tape system area write failure", "C"), 52: ("tape system area read failure", "C"), 53: ("no start of data", "C"), 54: ("loading failure", "C"), 55: ("unrecoverable unload failure", "C"),
    56: ("automation interface failure", "C"), 57: ("firmware failure", "W"), 58: ("WORM integrity check failed", "W"), 59: ("WORM overwrite attempted", "W"),
}
SEVERITIES = {"I": "info", "W": "warning", "C": "critical"}


def name_of(code: Column, names: dict, fallback: Column | None = None) -> Column:
    """The name of a code, else the fallback (null if none). A literal map: no join, no UDF."""
    found = F.try_element_at(F.create_map(*map(F.lit, chain(*names.items()))), code)
    return found if fallback is None else F.coalesce(found, fallback)


def hex_name(prefix: str, code: Column, digits: int = 2) -> Column:
    return F.concat(F.lit(f"{prefix} 0x"), F.lower(F.lpad(F.hex(code.cast("long")), digits, "0")))


def density_name(code: Column, worm: Column) -> Column:
    return F.concat(name_of(code, DENSITIES, hex_name("density", code)), F.when(worm, " WORM").otherwise(""))


def sense_text(asc: Column, ascq: Column) -> Column:
    return name_of((asc * 256 + ascq).cast("int"), SENSE_CODES)


def error_description(key: Column, asc: Column, ascq: Column) -> Column:
    name = name_of((key.cast("int") % 16), SENSE_KEYS)
    told = F.concat(F.lit(": "), sense_text(asc, ascq))
    raw = F.concat(F.lit(" (ASC 0x"), F.lower(F.lpad(F.hex(asc.cast("long")), 2, "0")), F.lit(", ASCQ 0x"), F.lower(F.lpad(F.hex(ascq.cast("long")), 2, "0")), F.lit(")"))
    return F.concat(name, F.coalesce(told, raw))


def operation_name(op: Column) -> Column:
    return name_of(op.cast("int"), OPERATIONS, hex_name("command", op))


def error_time(ms: Column, origin: Column) -> Column:
    """A UTC minute where a host set the clock, else days and hours (or hours and minutes) after a power-on; empty if 0."""
    hours = F.floor(ms / 3_600_000)
    days = F.floor(hours / 24)
    power = F.when(days > 0, F.format_string("%dd %dh after a power-on", days, hours % 24)).otherwise(F.format_string("%dh %dm after a power-on", hours, F.floor(ms / 60_000) % 60))
    host = F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
    return F.when(ms == 0, "").when((origin != 0) & (ms < 1 << 47), host).otherwise(power)
