"""Record schemas of the archive. Sizes are bytes, times are epoch nanoseconds as long, counters are decimal(20,0)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, X, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.BinaryType(), T.TimestampType()
COUNTER = T.DecimalType(20, 0)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def array(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


REF_TYPE = struct(tape=S, path=S)
AGE_TYPE = struct(size=L, sha256=S, recipients=array(S))
LAYOUT_TYPE = struct(scheme=S, k=I, m=I, d=I, shard_size=L, size=L)
#: The same as text, for casts.
REF, AGE, LAYOUT = (x.simpleString() for x in (REF_TYPE, AGE_TYPE, LAYOUT_TYPE))

#: As lines carry them; times are RFC 3339 text there.
ENTRY_LINE = struct(path=S, size=L, sha256=S, mtime=S, source=S, archived_at=S, ref=REF_TYPE, recovered=B, age=AGE_TYPE)
CHUNKS_LINE = struct(path=S, chunk_size=L, sha256=array(S))
PARITY_LINE = struct(path=S, layout=LAYOUT_TYPE, offset=L, hashes=array(S), data_hashes=array(S))
PENDING_LINE = struct(entry=ENTRY_LINE, chunks=CHUNKS_LINE, parity=PARITY_LINE)
JOURNAL_LINE = struct(offset=L, state=X, chunks=array(S), sha256=S, parity_hashes=array(S))
VOLUME = struct(id=S, label=S, ltfs_uuid=S, created=S)

ENTRIES = struct(tape_id=S, segment=I, line_no=L, path=S, size=L, sha256=S, mtime_ns=L, source=S, archived_at_ns=L, ref=REF_TYPE, recovered=B, age=AGE_TYPE)
TAPES = struct(id=S, label=S, ltfs_uuid=S, created_ns=L, files=I, bytes=L, imported_at_ns=L, retired_ns=L, encryption=struct(method=S, keys=array(S), since_ns=L))
VERIFICATIONS = struct(tape_id=S, seq=L, at_ns=L, files=I, verified=I, repairable=I, failed=I, problems=I)
SOURCE_FILES = struct(path=S, rel=S, size=L, mtime_ns=L, change_id=S, content=X)
LOG_PAGES = struct(drive=S, poll_ts=TS, page=I, raw=X)
COUNTERS = struct(drive=S, ts=TS, write_corrected=COUNTER, write_uncorrected=COUNTER, read_corrected=COUNTER, read_uncorrected=COUNTER, non_medium=COUNTER)
