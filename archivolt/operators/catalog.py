"""Catalog queries: which content is where, in how many copies, verified when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.ordered import last_wins


def in_subtree(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or below it; slashes at either end of the prefix don't count, an empty one takes all."""
    p = prefix.strip("/")
    return F.lit(True) if not p else (path == p) | path.startswith(p + "/")


def clean_path(path: Column) -> Column:
    """A path without empty and . components, and with .. taken with the component before it; a leading slash stays."""
    rooted = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = F.when(last.isNotNull() & (last != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.array_append(done, ".."))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    text = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), text)).otherwise(F.when(text == "", ".").otherwise(text))


def within(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or inside it, as written: both absolute or both relative, cleaned first. Unlike in_subtree(), a
    leading slash counts. Nothing relative is known to lie in a folder that begins with .. unless it begins so too."""
    p, f = clean_path(path), clean_path(folder)
    below = F.when(f == "/", p.startswith("/")).when(f == ".", ~p.startswith("/") & (p != "..") & ~p.startswith("../")).otherwise((p == f) | (p.startswith(F.concat(f, F.lit("/"))) & ~F.substring(p, F.length(f) + 2, F.lit(2)).eqNullSafe("..")))
    return F.coalesce(below, F.lit(False))


def search(entries: DataFrame, text: str) -> DataFrame:
    """Entries whose path holds the text or whose SHA-256 begins with it, whatever the case; % and _ are ordinary."""
    q = text.lower()
    return entries.where(F.lower("path").contains(q) | F.col("sha256").startswith(q))


def is_content(ref: str = "ref") -> Column:
    return F.col(ref).isNull()


def stored_view(entries: DataFrame, suffix: str = ".age") -> DataFrame:
    """Entries as they lie on tape: an encrypted one under path + suffix, with the size and hash of its encrypted form."""
    age = F.col("age").isNotNull()
    new = {"path": F.when(age, F.concat("path", F.lit(suffix))).otherwise(F.col("path")), "size": F.when(age, F.col("age.size")).otherwise(F.col("size")), "sha256": F.when(age, F.col("age.sha256")).otherwise(F.col("sha256"))}
    return entries.select(*(new[c].alias(c) if c in new else F.col(c) for c in entries.columns))


def passed(v: Column) -> Column:
    return (v["failed"] == 0) & (v["repairable"] == 0) & (v["problems"] == 0)


def last_verification(verifications: DataFrame) -> DataFrame:
    """Each tape's last verification by append order (seq), not by time."""
    rest = [c for c in verifications.columns if c != "tape_id"]
    last = verifications.groupBy("tape_id").agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return last.select("tape_id", F.col("v.at_ns").alias("verified_at_ns"), passed(F.col("v")).alias("verified_ok"), "v")


def verified_since(ok: Column, at: Column, since: Column) -> Column:
    """Whether the last verification passed, strictly after `since`; never verified is false."""
    return F.coalesce(ok & (at > since), F.lit(False))


def all_hits(tapes: DataFrame, entries: DataFrame) -> DataFrame:
    """Every tape's entries; the tape table is left to the optimiser, which broadcasts it while it is small."""
    return tapes.withColumnRenamed("id", "tape_id").join(entries, "tape_id")


def written_hits(written: DataFrame, tapes: DataFrame) -> DataFrame:
    """This machine's own log with its tapes; an unknown tape gives a row with its id alone."""
    return written.join(tapes.withColumnRenamed("id", "tape_id"), "tape_id", "left")


def tape_totals(entries: DataFrame) -> DataFrame:
    """files: all rows; bytes: of rows with content."""
    return entries.groupBy("tape_id").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(is_content(), F.col("size"))), F.lit(0)).alias("bytes"))


def list_totals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """files and bytes of a listing: references count with their size too."""
    return entries.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def copy_index(entries: DataFrame, tapes: DataFrame | None = None) -> DataFrame:
    """sha256, copies, tape_ids (sorted): active tapes that hold the content itself, each once.

    (sha256, tape) pairs are made distinct first, so a content with very many rows is reduced map-side and a hot
    hash meets at most as many rows as there are tapes.
    """
    pairs = entries.where(is_content()) if "ref" in entries.columns else entries
    if tapes is not None:
        pairs = pairs.join(tapes.where("retired_ns is null").select(F.col("id").alias("tape_id")), "tape_id", "left_semi")
    pairs = pairs.select("sha256", "tape_id").distinct()
    return pairs.groupBy("sha256").agg(F.count("*").alias("copies"), F.array_sort(F.collect_list("tape_id")).alias("tape_ids"))


def size_index(entries: DataFrame) -> DataFrame:
    """size, files: how many content rows share a size; the rows themselves stay in entries, to be joined on size."""
    return entries.where(is_content()).groupBy("size").agg(F.count("*").alias("files"))


def other_copies(entries: DataFrame) -> DataFrame:
    """entries with other_tapes: tapes other than the row's own that hold its content, sorted."""
    index = copy_index(entries).select("sha256", "tape_ids")
    others = F.array_remove("tape_ids", F.col("tape_id"))
    return entries.join(index, "sha256", "left").withColumn("other_tapes", F.coalesce(others, F.array().cast("array<string>"))).drop("tape_ids")


def copies_with(index: DataFrame, here: DataFrame) -> DataFrame:
    """sha256, n: copies on other tapes plus one if `here` (sha256 of this tape's content) has it."""
    mine = here.select("sha256").distinct().withColumn("mine", F.lit(1))
    return index.join(mine, "sha256", "full").select("sha256", (F.coalesce("copies", F.lit(0)) + F.coalesce("mine", F.lit(0))).alias("n"))


def find_tape(uuid: str | None, entries: DataFrame, tapes: DataFrame, catalog: DataFrame) -> DataFrame:
    """The id of the tape that a mounted tape is: by its volume UUID where it is known, else by agreement of its
    entries. No row unless exactly one tape matches. UUIDs are compared in lower case."""
    if uuid:
        found = tapes.where(F.lower("ltfs_uuid") == uuid.lower()).select("id")
    else:
        found = tapes.select("id").join(matching_tapes(entries, catalog), F.col("id") == F.col("tape_id"), "left_semi")
    return found.groupBy().agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id")


def matching_tapes(entries: DataFrame, catalog: DataFrame, first: int = 50) -> DataFrame:
    """tape_id of cataloged tapes whose manifests hold each of the first entries, in order, with the same hash.

    Of a path's records on a tape the last counts. The catalog is cut to the few paths asked for before it is grouped.
    """
    head = entries.orderBy("segment", "line_no").limit(first).select("path", "sha256").distinct()
    known = catalog.select("tape_id", "path", "sha256", "segment", "line_no").join(F.broadcast(head.select("path").distinct()), "path", "left_semi")
    hits = last_wins(known, ["tape_id", "path"], ["segment", "line_no"]).join(F.broadcast(head), ["path", "sha256"]).groupBy("tape_id").agg(F.count("*").alias("hits"))
    wanted = head.agg(F.count("*").alias("wanted"))
    return hits.join(F.broadcast(wanted), F.col("hits") == F.col("wanted")).where("wanted > 0").select("tape_id")


def tapes_in_order(tapes: DataFrame) -> DataFrame:
    return tapes.orderBy("label", "id")


def lookup(tapes: DataFrame, name: str) -> DataFrame:
    """n_found and id: of tapes whose id or label is name; id is null unless there is exactly one."""
    found = tapes.where((F.col("id") == name) | (F.col("label") == name)).agg(F.count("*").alias("n_found"), F.min("id").alias("id"))
    return found.select("n_found", F.when(F.col("n_found") == 1, F.col("id")).alias("id"))


# Updates: each returns the new table, to be written by archivolt.sinks


def import_tape(tapes: DataFrame, entries: DataFrame, volumes: DataFrame, now_ns: int) -> DataFrame:
    """tapes with volumes' rows updated or added: counts come from their entries; history, retirement and encryption stay."""
    totals = tape_totals(entries)
    new = volumes.join(totals.withColumnRenamed("tape_id", "id"), "id", "left").select("id", "label", "ltfs_uuid", "created_ns", F.coalesce("files", F.lit(0)).cast("int").alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.lit(now_ns).alias("imported_at_ns"))
    kept = tapes.select("id", "retired_ns", "encryption")
    return tapes.join(volumes, "id", "left_anti").unionByName(new.join(kept, "id", "left").select(*tapes.columns))


def set_retired(tapes: DataFrame, tape_id: str, retired: bool, now_ns: int) -> DataFrame:
    at = F.coalesce("retired_ns", F.lit(now_ns)) if retired else F.lit(None).cast("long")
    return tapes.withColumn("retired_ns", F.when(F.col("id") == tape_id, at).otherwise(F.col("retired_ns")))


def record_encryption(tapes: DataFrame, tape_id: str, method: str, key: str, now_ns: int) -> DataFrame:
    """Adds a key id to a tape's set of keys; the first time stays."""
    old = F.col("encryption")
    keys = F.array_union(F.coalesce(old["keys"], F.array().cast("array<string>")), F.array(F.lit(key)))
    new = F.struct(F.lit(method).alias("method"), keys.alias("keys"), F.coalesce(old["since_ns"], F.lit(now_ns)).alias("since_ns"))
    return tapes.withColumn("encryption", F.when(F.col("id") == tape_id, new).otherwise(old))


def append_verification(verifications: DataFrame, row: DataFrame) -> DataFrame:
    """verifications with rows appended, numbered after the last of their tape."""
    last = verifications.groupBy("tape_id").agg(F.max("seq").alias("last"))
    at = F.row_number().over(Window.partitionBy("tape_id").orderBy("at_ns"))
    new = row.join(last, "tape_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + at).drop("last")
    return verifications.unionByName(new.select(*verifications.columns))
