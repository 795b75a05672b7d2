"""Scalar functions: sizes, times, names, bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = (1 << 64) - 1


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def file_key(path: Column) -> Column:
    """The first 16 bytes of the path's SHA-256, in hex."""
    return F.substring(F.sha2(path, 256), 1, 32)


def format_bytes(n: Column) -> Column:
    """Binary units with one decimal, halves rounded to even; plain bytes below 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        out = F.when(n >= 1 << (10 * i), F.concat(F.format_string("%.1f", F.bround(n / float(1 << (10 * i)), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """HH:MM:SS, rounded to seconds."""
    s = F.round(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def printable(raw: Column) -> Column:
    """The ASCII text of a binary field."""
    return F.trim(F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[^ -~]", ""))


def term_safe(text: Column) -> Column:
    r"""Control characters (C0 but \n, \r and \t, DEL, C1) as \xNN, so that a file name can't steer a terminal."""
    shown = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"\A[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]\z"), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c))
    return F.array_join(shown, "")


def ebcdic(raw: Column) -> Column:
    """Letters, digits and blanks of an EBCDIC field; other bytes are left out."""
    codes = {0x40: " "} | {c + i: chr(ord(a) + i) for c, a, n in ((0x81, "a", 9), (0x91, "j", 9), (0xA2, "s", 8), (0xC1, "A", 9), (0xD1, "J", 9), (0xE2, "S", 8), (0xF0, "0", 10)) for i in range(n)}
    latin = "".join(map(chr, codes))
    kept = F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[^" + "".join(f"\\x{{{c:x}}}" for c in codes) + "]", "")
    return F.trim(F.translate(kept, latin, "".join(codes.values())))


def key_id(raw: Column) -> Column:
    """A key id as key files write it: three printable characters and nine bytes in hex; else text if printable, else hex."""
    head, text = F.substring(raw, 1, 3), F.decode(raw, "ISO-8859-1")
    return (
        F.when(F.octet_length(raw) == 0, "")
        .when((F.octet_length(raw) == 12) & (printable(head) == F.decode(head, "ISO-8859-1")), F.concat(F.decode(head, "ISO-8859-1"), F.lower(F.hex(F.substring(raw, 4, 9)))))
        .when(printable(raw) == text, text)
        .otherwise(F.lower(F.hex(raw)))
    )


def be_uint(raw: Column) -> Column:
    """A big-endian unsigned number of 1 to 8 bytes as decimal(20,0); null for other lengths."""
    return F.when(F.octet_length(raw).between(1, 8), F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)"))


def be_int(raw: Column, at: int, n: int) -> Column:
    """A big-endian number of up to 7 bytes at an offset, as long."""
    return F.conv(F.hex(F.substring(raw, at + 1, n)), 16, 10).cast("long")


def mega_and_bytes(mega: Column, rest: Column) -> Column:
    """Millions and a rest as one number, at most 2^64 - 1; null if either is missing."""
    total = mega.cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)") + rest.cast("decimal(38,0)")
    return F.when(total.isNotNull(), F.least(total, F.lit(str(U64)).cast("decimal(38,0)"))).cast("decimal(20,0)")  # least() passes nulls over


def metadata_reserve(entries: Column, size: Column, chunk: int = 4 << 20) -> Column:
    """Bytes kept free for metadata: 256 MiB, 400 for each entry and 100 for each whole chunk."""
    return F.lit(256 << 20) + entries * 400 + F.floor(size / chunk) * 100


def sealed_chunks(size: Column) -> Column:
    return F.greatest(F.ceil(size / 65536), F.lit(1)).cast("long")


def sealed_stored_size(size: Column, header: Column) -> Column:
    """Bytes of an encrypted file: header, nonce, content, and a tag for each 64 KiB piece."""
    return header + 16 + size + 16 * sealed_chunks(size)


def tape_name(label: Column, tape_id: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), tape_id)


def tape_list(names: Column, this: Column) -> Column:
    """'this tape', 'tape X' or 'tapes X, Y' for an array of names; this: the name that is the tape at hand."""
    return F.when((F.size(names) == 1) & (F.get(names, F.lit(0)) == this), "this tape").when(F.size(names) == 1, F.concat(F.lit("tape "), F.get(names, F.lit(0)))).otherwise(F.concat(F.lit("tapes "), F.array_join(names, ", ")))


def cleaning_warning(required: Column, requested: Column) -> Column:
    """Required goes before requested; null if neither."""
    return F.when(required, "drive needs cleaning now").when(requested, "drive requests cleaning")


def firmware_build(raw: Column) -> Column:
    """The build time of a level page; empty where its digits aren't."""
    t, d = F.decode(F.substring(raw, 17, 6), "ISO-8859-1"), F.decode(F.substring(raw, 24, 8), "ISO-8859-1")
    told = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit(" "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 2))
    return F.when(F.octet_length(raw) >= 43, F.when(t.rlike(r"\A[0-9]{6}\z") & d.rlike(r"\A[0-9]{8}\z"), told).otherwise(""))


def coherency_uuid(raw: Column) -> Column:
    """The volume UUID in a coherency attribute: after a length-prefixed reference, 16 bytes and a length, text that says LTFS."""
    start = be_int(raw, 0, 1) + 17
    n = F.conv(F.hex(F.substring(raw, (start + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
    body = F.decode(F.substring(raw, (start + 3).cast("int"), F.least(n, F.lit(41)).cast("int")), "ISO-8859-1")
    fits = (n >= 41) & (start + 2 + n <= F.octet_length(raw)) & body.startswith("LTFS")
    uuid = F.substring(body, 6, 36)
    return F.when(fits & uuid.rlike(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"), uuid).otherwise("")
