"""Files copied to a tape's folder, and files deleted after a purge plan, by the executors; both check the source again as they go."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.operators.content import CHUNK_SIZE

ARCHIVED = "path string, result string, size long, sha256 string, chunks array<string>"


def archive_one(source: str, target: str, size: int, mtime_ns: int, chunk_size: int) -> tuple[str, int | None, str | None, list[str] | None]:
    """(result, bytes, SHA-256, of each piece) of copying a file: ARCHIVED, or EXISTS (nothing is overwritten), CHANGED (the source is not,
    or no longer, what was planned), UNREADABLE. One piece is held at a time; the copy gets its name only once it is whole."""
    import os
    import uuid

    place = Path(target)
    if place.exists():
        return "EXISTS", None, None, None
    partial = place.with_name(f".{place.name}.{uuid.uuid4().hex}.partial")
    same = lambda s: (s.st_size, s.st_mtime_ns) == (size, mtime_ns)
    try:
        if not same(os.stat(source)):
            return "CHANGED", None, None, None
        place.parent.mkdir(parents=True, exist_ok=True)
        whole, pieces, done = sha256(), [], 0
        with open(source, "rb") as f, partial.open("xb") as out:
            while piece := f.read(chunk_size):
                whole.update(piece)
                pieces.append(sha256(piece).hexdigest())
                out.write(piece)
                done += len(piece)
            out.flush()
            os.fsync(out.fileno())
            if done != size or not same(os.fstat(f.fileno())):
                return "CHANGED", None, None, None
        os.utime(partial, ns=(mtime_ns, mtime_ns))
        os.link(partial, place)
        return "ARCHIVED", done, whole.hexdigest(), pieces
    except FileExistsError:
        return "EXISTS", None, None, None
    except OSError:
        return "UNREADABLE", None, None, None
    finally:
        partial.unlink(missing_ok=True)


def archive_files(files: DataFrame, folder: str, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """path, result, size, sha256, chunks of copying files (source, path, size, mtime_ns) below a folder all executors share.

    See archive_one(). A task that is tried again finds what it has published and says EXISTS, which hash_files() can confirm.
    """
    rows = files.select("source", "path", F.concat(F.lit(folder.rstrip("/") + "/"), "path").alias("target"), F.col("size").cast("long"), F.col("mtime_ns").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["path"], *archive_one(r["source"], r["target"], r["size"], r["mtime_ns"], chunk_size)) for r in batch.to_pylist()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["path", "result", "size", "sha256", "chunks"])

    return rows.mapInArrow(run, ARCHIVED)


def delete_one(root: str, path: str, size: int, mtime_ns: int) -> str:
    """DELETED, or why not: CHANGED since the plan, GONE, OUTSIDE the root (a folder on the way is a link), FAILED."""
    import os
    import stat

    place = Path(root, path)
    try:
        if place.parent.resolve() != Path(root).resolve() / Path(path).parent or ".." in Path(path).parts:
            return "OUTSIDE"
        found = os.lstat(place)
        if not stat.S_ISREG(found.st_mode) or (found.st_size, found.st_mtime_ns) != (size, mtime_ns):
            return "CHANGED"
        place.unlink()
        return "DELETED"
    except FileNotFoundError:
        return "GONE"
    except OSError:
        return "FAILED"


def delete_files(planned: DataFrame, root: str) -> DataFrame:
    """path, result of deleting the files (path below root, size, mtime_ns) whose decision is DELETE, each checked again right before."""
    rows = planned.where("decision = 'DELETE'").select("path", F.col("size").cast("long"), F.col("mtime_ns").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([delete_one(root, r["path"], r["size"], r["mtime_ns"]) for r in rows], pa.string())], ["path", "result"])

    return rows.mapInArrow(run, "path string, result string")


def remove_folders(folders: list[str], root: str) -> list[str]:
    """Of folders below root those removed: empty ones, the deepest first; never the root itself, never what holds anything."""
    gone = []
    for folder in sorted(folders, key=lambda f: (-f.count("/"), f)):
        place = Path(root, folder)
        try:
            if place.resolve() != Path(root).resolve() / folder:
                continue
            place.rmdir()
            gone.append(folder)
        except OSError:
            continue
    return gone
