"""Registered queries of plans, records and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt import reports, schemas
from archivolt.functions import scalars, validate
from archivolt.operators import catalog, content, ordered, resume
from archivolt.plans import purge, put, tape
from archivolt.queries import ENTRIES_SQL, entries, plain_entries, query, table
from archivolt.sources.tapes import sources_checked


def no_age() -> Column:
    return F.lit(None).cast(schemas.AGE).alias("age")


def no_ref() -> Column:
    return F.lit(None).cast(schemas.REF).alias("ref")


def at() -> Column:
    return F.lit(0).cast("long")


# Plans


@query(ENTRIES_SQL + """
    , o AS (SELECT path, line_no, first_value(path) OVER (PARTITION BY sha256 ORDER BY string_split(path, '/')) AS head FROM e)
    SELECT path, CASE WHEN line_no % 2 = 0 AND head <> path THEN 'SKIP_ELSEWHERE' ELSE 'ARCHIVE' END AS decision FROM o
""")
def second_copies(spark, sf_dir):
    """Two copies wanted: a recorded file is skipped once this run has written its content itself."""
    rows = plain_entries(spark, sf_dir)
    files = rows.select(F.col("path").alias("rel"), F.col("path").alias("source"), "size", at().alias("mtime_ns"), "sha256")
    on1 = rows.where("line_no % 2 = 0").select(F.lit("T1").alias("tape_id"), "segment", "line_no", "path", "size", "sha256", at().alias("mtime_ns"), F.col("path").alias("source"), at().alias("archived_at_ns"), no_ref(), F.lit(False).alias("recovered"), no_age())
    tapes = spark.createDataFrame([("T1", "", None, 0, 0, 0, 0, None, None)], schemas.TAPES)
    planned = put.decide(files, spark.createDataFrame([], schemas.ENTRIES), on1, on1, tapes, "new", copies=2, dedup=False)
    return planned.select(F.col("rel").alias("path"), "decision")


@query("""
    WITH t AS (SELECT lang || '/' || doc_id AS path, strlen(text) AS n, sum(strlen(text)) OVER (ORDER BY string_split(lang || '/' || doc_id, '/')) AS total FROM documents)
    SELECT path, CASE WHEN total <= 200000 THEN 'ARCHIVE' WHEN total - n <= 200000 AND n > 0 THEN 'FULL' ELSE 'STOPPED' END AS decision FROM t
""")
def full_tape(spark, sf_dir):
    """Where a run stops because the tape is full."""
    planned = plain_entries(spark, sf_dir).select(F.col("path").alias("rel"), "size", F.lit("ARCHIVE").alias("decision"))
    return put.until_full(planned, F.col("size"), 200_000).select(F.col("rel").alias("path"), "decision")


@query(ENTRIES_SQL + """
    , l AS (SELECT e.*, l.doc_id IS NOT NULL AS known, l.toxic FROM e LEFT JOIN labels l ON e.line_no = l.doc_id)
    SELECT path, CASE WHEN known AND toxic = 1 THEN 'CONFLICT' WHEN known THEN 'RECORDED' WHEN line_no % 10 = 0 OR line_no % 3 = 0 THEN 'ROLLED_BACK' ELSE 'NEW' END AS decision FROM l
""")
def flush_plan(spark, sf_dir):
    """Pending records against the tape's manifest and its files."""
    rows = plain_entries(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("line_no"), "toxic")
    on_tape = rows.join(labels, "line_no").select("path", F.when(F.col("toxic") == 1, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    listing = rows.select("path", (F.col("size") + (F.col("line_no") % 3 == 0).cast("long")).alias("size"), (F.col("line_no") % 10 != 0).alias("regular"))
    return tape.flush(rows.select("path", "size", "sha256", no_ref(), no_age()), on_tape, listing).select("path", "decision")


@query(ENTRIES_SQL + """
    , s AS (SELECT e.*, CASE WHEN l.doc_id IS NULL THEN 'failed' WHEN l.quality = 1 THEN 'OK' ELSE 'repairable' END AS status FROM e LEFT JOIN labels l ON e.line_no = l.doc_id),
    x AS (SELECT a.tape_id, a.path, coalesce(string_agg(DISTINCT b.tape_id, ',' ORDER BY b.tape_id), '') AS others FROM e a LEFT JOIN e b ON a.sha256 = b.sha256 AND a.tape_id <> b.tape_id AND b.ref_path IS NULL GROUP BY 1, 2),
    r AS (SELECT s.*, others, CASE WHEN ref_path IS NOT NULL THEN 'REF' WHEN line_no % 4 = 0 THEN 'EXISTS' WHEN status = 'failed' THEN 'FAILED' WHEN status = 'repairable' THEN 'REPAIR' ELSE 'RESTORE' END AS decision FROM s JOIN x USING (tape_id, path))
    SELECT tape_id, path, decision, CASE WHEN decision IN ('REF', 'FAILED') THEN others END AS other_tapes FROM r WHERE starts_with(path, 'en/')
""")
def restore_plan(spark, sf_dir):
    """What a restore of one folder does with each entry, and where failed content lies too."""
    rows = entries(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("line_no"), "quality")
    status = F.when(F.col("quality").isNull(), "failed").when(F.col("quality") == 1, "OK").otherwise("repairable")
    seen = rows.select("tape_id", "path", "line_no").join(labels, "line_no", "left").select("tape_id", "path", status.alias("status"))
    plan = tape.restore(rows, seen, "en", rows.where("line_no % 4 = 0").select("path"))
    return plan.select("tape_id", "path", "decision", F.array_join("other_tapes", ",").alias("other_tapes"))


@query("""
    WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 2 = 0 AS was, c_custkey % 3 <> 0 AS encrypting, c_nationkey % 3 = c_custkey % 5 AS same_key, c_nationkey AS files FROM customer)
    SELECT id, CASE WHEN was AND NOT encrypting THEN 'REFUSE' WHEN encrypting AND was AND NOT same_key THEN 'NOTE' WHEN encrypting AND NOT was AND files > 0 THEN 'NOTE' ELSE 'ALLOW' END AS decision FROM t
""")
def encryption_gate(spark, sf_dir):
    """Whether each tape may be written with the drive as it is set (Q8)."""
    c = table(spark, sf_dir, "customer")
    keys = F.struct(F.lit("aes").alias("method"), F.array(F.concat(F.lit("k"), (F.col("c_nationkey") % 3).cast("string"))).alias("keys"), at().alias("since_ns"))
    tapes = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("files"), F.when(F.col("c_custkey") % 2 == 0, keys).alias("encryption"))
    drives = c.select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 3 != 0).alias("encrypting"), F.concat(F.lit("k"), (F.col("c_custkey") % 5).cast("string")).alias("key"))
    return tape.encryption_gate(tapes, drives).select("id", "decision")


@query("""
    WITH d AS (SELECT doc_id, lang || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents), h AS (SELECT * FROM d ORDER BY doc_id LIMIT 50),
    c AS (SELECT 'same' AS tape_id, path, sha256, 1 AS segment FROM d UNION ALL SELECT 'older', path, sha256, 2 FROM d UNION ALL SELECT 'older', path, 'x', 1 FROM h
          UNION ALL SELECT 'newer', path, sha256, 1 FROM d UNION ALL SELECT 'newer', path, 'x', 2 FROM h WHERE doc_id % 7 = 0 UNION ALL SELECT 'part', path, sha256, 1 FROM d WHERE doc_id > 0),
    l AS (SELECT tape_id, path, arg_max(sha256, segment) AS sha256 FROM c GROUP BY 1, 2)
    SELECT tape_id FROM l JOIN h USING (path, sha256) GROUP BY tape_id HAVING count(*) = (SELECT count(*) FROM h)
""")
def tape_identity(spark, sf_dir):
    """Cataloged tapes that list a mounted tape's first entries; of a path's records the last counts."""
    rows = plain_entries(spark, sf_dir).select("path", "sha256", "line_no", "segment")
    first = rows.orderBy("line_no").limit(50)
    as_tape = lambda df, name, segment=1, sha=None: df.select(F.lit(name).alias("tape_id"), "path", F.lit(sha).alias("sha256") if sha else F.col("sha256"), F.lit(segment).alias("segment"), "line_no")
    parts = [as_tape(rows, "same"), as_tape(rows, "older", 2), as_tape(first, "older", 1, "x"), as_tape(rows, "newer"), as_tape(first.where("line_no % 7 = 0"), "newer", 2, "x"), as_tape(rows.where("line_no > 0"), "part")]
    known = parts[0]
    for p in parts[1:]:
        known = known.unionByName(p)
    return catalog.matching_tapes(rows, known)


@query("SELECT stored, 2 AS files FROM (SELECT 'f' || (doc_id // 2) || CASE WHEN doc_id % 2 = 0 THEN '.age' ELSE '' END || CASE WHEN doc_id % 2 = 1 THEN '.age' ELSE '' END AS stored FROM documents) GROUP BY stored HAVING count(*) = 2")
def name_collisions(spark, sf_dir):
    """Stored names that a plain and an encrypted file would both take."""
    odd = F.col("doc_id") % 2 == 1
    name = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2).cast("string"))
    files = table(spark, sf_dir, "documents").select(F.when(odd, name).otherwise(F.concat(name, F.lit(".age"))).alias("rel"), odd.alias("encrypted"))
    return put.collisions(files).select("stored", F.col("files").cast("int").alias("files"))


@query("SELECT CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN strlen(text) + 100 ELSE strlen(text) END) AS BIGINT) AS bytes, CAST(sum(doc_id) AS BIGINT) AS parity_bytes FROM documents")
def pending_totals(spark, sf_dir):
    """Bytes that pending records have stored."""
    rows = plain_entries(spark, sf_dir)
    age = F.struct((F.col("size") + 100).alias("size"), F.lit("").alias("sha256"), F.array(F.lit("r")).alias("recipients"))
    ref = F.struct(F.lit("t").alias("tape"), F.lit("p").alias("path"))
    return tape.pending_totals(rows.select("size", F.when(F.col("line_no") % 3 == 0, ref).alias("ref"), F.when(F.col("line_no") % 2 == 0, age).alias("age"), F.col("line_no").alias("parity_bytes")))


@query("SELECT count(*) FILTER (WHERE doc_id % 3 <> 0) AS \"delete\", count(*) FILTER (WHERE doc_id % 3 = 0) AS keep, CAST(sum(strlen(text)) FILTER (WHERE doc_id % 3 <> 0) AS BIGINT) AS bytes, string_agg(DISTINCT source, ',' ORDER BY source) FILTER (WHERE doc_id % 3 <> 0) AS tapes FROM documents")
def purge_totals(spark, sf_dir):
    """What a purge would delete and keep."""
    planned = plain_entries(spark, sf_dir).select("path", "size", F.when(F.col("line_no") % 3 == 0, "KEEP").otherwise("DELETE").alias("decision"), F.array("tape_id").alias("tapes"))
    return purge.totals(planned).withColumn("tapes", F.array_join("tapes", ","))


@query("SELECT source, count(*) FILTER (WHERE doc_id % 5 = 0) AS damaged, count(*) AS shards, CASE WHEN count(*) FILTER (WHERE doc_id % 5 = 0) > 0 THEN count(*) FILTER (WHERE doc_id % 5 = 0) || ' of ' || count(*) || ' pieces damaged' END AS told FROM documents GROUP BY source")
def damaged_parity(spark, sf_dir):
    """Parity pieces that don't match their hashes."""
    rows = plain_entries(spark, sf_dir).select(F.col("tape_id").alias("source"), F.col("sha256").alias("wanted"), F.when(F.col("line_no") % 10 == 0, F.lit(None)).when(F.col("line_no") % 5 == 0, "x").otherwise(F.col("sha256")).alias("got"))
    return content.damaged_parity(rows, ["source"])


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'OK' ELSE 'failed' END AS status, CASE WHEN doc_id % 4 = 1 AND strlen(text) > 0 THEN 'damaged bytes: 0-' || (least(256, strlen(text)) - 1) WHEN doc_id % 4 = 2 AND strlen(text) > 0 THEN 'file is cut short, bytes ' || (strlen(text) // 2 // 256 * 256) || '-' || (strlen(text) - 1) || ' missing' END AS detail FROM documents WHERE doc_id % 4 < 3 AND strlen(text) > 0")
def file_scan(spark, sf_dir):
    """Files read back against their chunk hashes: intact, one byte changed, cut to half."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")).where("doc_id % 4 < 3 and length(content) > 0")
    parts = content.chunk_hashes(rows, ["doc_id"], "content", 256).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda x: x["sha256"]).alias("chunk_sha256"))
    listed = rows.select("doc_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.lit(256).cast("long").alias("chunk_size")).join(parts, "doc_id")
    n, turn = F.octet_length("content"), F.col("doc_id") % 4
    changed = F.concat(F.unhex(F.lit("00")), F.substring(F.col("content"), F.lit(2), n))
    half = F.substring(F.col("content"), F.lit(1), F.floor(n / 2).cast("int"))
    found = content.scan(listed, rows.select("doc_id", F.when(turn == 1, changed).when(turn == 2, half).otherwise(F.col("content")).alias("content")), ["doc_id"])
    told = content.describe_damage(found, ["doc_id"])
    return told.select("doc_id", content.verify_status(F.lit(False)).alias("status"), "detail")


@query("""
    SELECT name AS path, CASE WHEN k = 0 AND labeled THEN NULL WHEN k = 0 THEN 'ORPHAN' ELSE 'IGNORED' END AS decision,
           CASE k WHEN 1 THEN 'incomplete transfer' WHEN 2 THEN 'not a regular file' WHEN 3 THEN 'unsupported file name' END AS reason
    FROM (SELECT doc_id % 4 AS k, lang || '/' || doc_id || CASE doc_id % 4 WHEN 1 THEN '.partial' WHEN 3 THEN '/./x' ELSE '' END AS name, doc_id IN (SELECT doc_id FROM labels) AS labeled FROM documents) WHERE NOT (k = 0 AND labeled)
""")
def recover_plan(spark, sf_dir):
    """Files on tape that no record names, and those that are left alone, with the reason."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i, F.concat("lang", F.lit("/"), i.cast("string")).alias("base"))
    listing = d.select(F.concat("base", F.when(i % 4 == 1, ".partial").when(i % 4 == 3, "/./x").otherwise("")).alias("path"), (i % 4 != 2).alias("regular"), F.lit(None).cast("long").alias("block"))
    meta = spark.createDataFrame([(".archive/x", True, None), ("SHA256SUMS", True, None)], "path string, regular boolean, block long")
    known = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").where("doc_id % 4 = 0")
    known = known.select(F.col("base").alias("path"), at().alias("size"), F.lit("").alias("sha256"), no_age())
    return tape.recover(listing.unionByName(meta), known).select("path", "decision", "reason")


@query("""
    WITH d AS (SELECT doc_id, lang || '/' || doc_id AS path, text <> '' AS there, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 7919) % 10007 END NULLS LAST, string_split(lang || '/' || doc_id, '/')) AS place FROM documents)
    SELECT path, place FROM d
""")
def tape_order(spark, sf_dir):
    """Reading order on a tape: known start blocks first, the rest in walk order."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), i.cast("string")).alias("path"), F.when(i % 3 != 0, (i * 7919) % 10007).alias("block"))
    return ordered.numbered(rows, ordered.tape_order()).select("path", "place")


@query("""
    WITH d AS (SELECT lang || '/' || source AS folder, doc_id % 2 = 0 OR source < 'm' AS deleted FROM documents)
    SELECT folder FROM (SELECT folder FROM d GROUP BY folder HAVING bool_and(deleted)) UNION SELECT split_part(folder, '/', 1) FROM d GROUP BY 1 HAVING bool_and(deleted)
""")
def emptied_folders(spark, sf_dir):
    """Folders that a purge leaves empty."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), ((F.col("doc_id") % 2 == 0) | (F.col("source") < "m")).alias("deleted"))
    return purge.emptied_folders(rows.where("deleted"), rows.where("not deleted"))


@query("SELECT doc_id AS file_key, doc_id % 2 = 0 AS journal, doc_id % 2 <> 0 AND doc_id % 3 = 0 AS staged FROM documents WHERE (doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels)) OR (doc_id % 2 <> 0 AND doc_id % 3 = 0)")
def stale_state(spark, sf_dir):
    """Journals of files recorded meanwhile, and staged parity without a journal."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_key"))
    journals, staged = tape.stale_state(ids.where("file_key % 2 = 0"), ids.where("file_key % 3 = 0"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_key")))
    return journals.select("file_key", F.lit(True).alias("journal"), F.lit(False).alias("staged")).unionByName(staged.select("file_key", F.lit(False).alias("journal"), F.lit(True).alias("staged")))


@query(ENTRIES_SQL + "SELECT sha256, count(DISTINCT tape_id) AS copies FROM e WHERE ref_path IS NULL AND tape_id > (SELECT min(source) FROM documents) GROUP BY sha256")
def active_copies(spark, sf_dir):
    """Copies on tapes that aren't retired."""
    rows = entries(spark, sf_dir)
    ids = rows.select(F.col("tape_id").alias("id")).distinct()
    first = ids.agg(F.min("id").alias("m")).first().m
    tapes = ids.withColumn("retired_ns", F.when(F.col("id") == first, F.lit(1)).cast("long"))
    return catalog.copy_index(rows, tapes).select("sha256", "copies")


@query("""
    WITH s AS (SELECT doc_id, unnest(range(0, 4)) AS j FROM documents)
    SELECT doc_id, CAST(CASE WHEN doc_id % 5 < 4 THEN doc_id % 5 ELSE 4 END AS BIGINT) AS valid, doc_id % 5 = 4 AND doc_id % 2 = 0 AS whole FROM documents
""")
def staged_parity(spark, sf_dir):
    """How many staged shards are intact from the start, and whether all are there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("j"))
    good = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("j").cast("string")).cast("binary")
    rows = d.select("doc_id", "j", good.alias("good"), (F.col("j") == F.col("doc_id") % 5).alias("bad"))
    staged = rows.where(~F.col("bad") | (F.col("doc_id") % 2 == 0)).select("doc_id", "j", F.when(F.col("bad"), F.lit("x").cast("binary")).otherwise(F.col("good")).alias("parity"))
    valid = resume.staged_valid(staged, rows.select("doc_id", "j", F.sha2("good", 256).alias("sha256")), ["doc_id"])
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.lit(4).cast("long").alias("shards"), F.lit(8).cast("long").alias("size"), F.when(F.col("doc_id") % 2 == 0, 8).otherwise(9).cast("long").alias("staged_size"))
    return resume.staged_whole(valid, sizes, ["doc_id"]).select("doc_id", "valid", "whole")


@query("SELECT source AS tape_id, lang || '/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, TRUE AS recovered, CAST((strlen(text) + 255) // 256 AS INTEGER) AS chunks FROM documents")
def recovered_entries(spark, sf_dir):
    """Entries and chunk lists made for files without records."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("tape_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), at().alias("mtime_ns"), F.encode("text", "UTF-8").alias("content"))
    made, lists = content.recovered_entries(files, 256)
    rows = made.join(lists.select("tape_id", "path", F.size("sha256").alias("chunks")), ["tape_id", "path"], "left")
    return rows.select("tape_id", "path", "size", "sha256", "recovered", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT path, decision, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT 'all' AS path, strlen(text) AS size, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY string_split(lang || '/' || doc_id, '/')) = 1 THEN 'ARCHIVE' ELSE 'DUPLICATE' END AS decision FROM documents) GROUP BY 1, 2")
def put_summary(spark, sf_dir):
    """What an archiving run did, by decision."""
    files = plain_entries(spark, sf_dir).select(F.col("path").alias("rel"), F.col("path").alias("source"), "size", at().alias("mtime_ns"), "sha256")
    none = spark.createDataFrame([], schemas.ENTRIES)
    return put.summary(put.decide(files, none, none, none, spark.createDataFrame([], schemas.TAPES), "new")).select(F.lit("all").alias("path"), "decision", "files", "bytes")


@query("SELECT source AS id, CAST(count(*) AS INTEGER) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(CASE WHEN source = (SELECT max(source) FROM documents) THEN 5 END AS BIGINT) AS retired_ns, CAST(9 AS BIGINT) AS imported_at_ns FROM documents GROUP BY source")
def imported_tapes(spark, sf_dir):
    """Tapes imported from their manifests; retirement stays (K8)."""
    rows = plain_entries(spark, sf_dir).withColumn("ref", no_ref())
    ids = rows.select(F.col("tape_id").alias("id")).distinct()
    last = ids.agg(F.max("id").alias("m")).first().m
    none = spark.createDataFrame([(last, "", None, 0, 0, 0, 0, 5, None)], schemas.TAPES)
    volumes = ids.select("id", F.col("id").alias("label"), F.lit(None).cast("string").alias("ltfs_uuid"), at().alias("created_ns"))
    return catalog.import_tape(none, rows, volumes, 9).select("id", "files", "bytes", "retired_ns", "imported_at_ns")


@query("SELECT doc_id % 3 = 1 AS same, count(*) AS files FROM documents GROUP BY 1")
def unchanged_sources(spark, sf_dir):
    """Interrupted transfers whose source is still the same, field by field, nulls alike (P10, F16)."""
    i = F.col("doc_id")
    header = lambda mtime, change: F.struct(F.col("source"), F.col("lang").alias("path"), F.col("n_chars").alias("size"), mtime.alias("mtime_ns"), change.alias("change_id"))
    a = header(i, F.when(i % 3 == 0, F.lit("c")))
    b = header(F.when(i % 3 == 2, i + 1).otherwise(i), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select(resume.same_source(a, b).alias("same")).groupBy("same").agg(F.count("*").alias("files"))


@query("""
    SELECT user_id, max(event_id) * 64 AS "offset" FROM events WHERE value < 80 AND event_id % 2 = 0 AND event_id * 64 <= 30000 GROUP BY user_id
""")
def resume_points(spark, sf_dir):
    """The last checkpoint at a window's boundary that the partial file still covers (W11, C15's resume point)."""
    rows = table(spark, sf_dir, "events").where("event_id * 64 <= 40000")
    points = rows.select("user_id", (F.col("event_id") * 64).alias("offset"), F.when(F.col("value") < 80, F.lit("s").cast("binary")).alias("state"), F.array_repeat(F.lit("h"), (F.col("event_id") * 4).cast("int")).alias("chunks"), F.lit(16).cast("long").alias("chunk_size"))
    return tape.pick_resume_point(points, ["user_id"], F.lit(30_000).cast("long"), 128).select("user_id", "offset")


@query("SELECT 'refused' AS decision, count(*) AS files FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'taken', count(*) FROM documents WHERE doc_id % 4 = 0")
def source_names(spark, sf_dir):
    """Source files whose names can't be archived."""
    i = F.col("doc_id")
    rel = F.concat("lang", F.lit("/"), i.cast("string"), F.when(i % 4 == 1, ".partial").when(i % 4 == 2, ".age").when(i % 4 == 3, "\n").otherwise(""))
    found = sources_checked(table(spark, sf_dir, "documents").select(rel.alias("rel")))
    return found.groupBy(F.when(F.col("refused").isNull(), "taken").otherwise("refused").alias("decision")).agg(F.count("*").alias("files"))


# Records


@query("""
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'invalid path' WHEN doc_id % 7 = 0 THEN 'invalid size' WHEN doc_id % 11 = 0 THEN 'invalid SHA-256' WHEN doc_id % 13 = 0 THEN 'invalid reference'
                        WHEN doc_id % 17 = 0 THEN 'encrypted reference or recovered file' WHEN doc_id % 19 = 0 THEN 'invalid encrypted size' WHEN doc_id % 23 = 0 THEN 'invalid recipients' END AS problem FROM documents
""")
def entry_rules(spark, sf_dir):
    """Why records are refused."""
    i = F.col("line_no")
    rows = plain_entries(spark, sf_dir)
    least = validate.sealed_size(F.col("size"))
    age = F.struct(F.when(i % 19 == 0, F.col("size")).otherwise(least + 200).alias("size"), F.col("sha256"), F.array(F.when(i % 23 == 0, "a b").otherwise("age1x")).alias("recipients"))
    ref = F.struct(F.lit("not-an-id").alias("tape"), F.lit("p").alias("path"))
    why = validate.entry_problem(
        F.when(i % 5 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")), F.when(i % 7 == 0, -1).otherwise(F.col("size")), F.when(i % 11 == 0, F.upper("sha256")).otherwise(F.col("sha256")),
        F.when(i % 13 == 0, ref), F.when((i % 17 == 0) | (i % 19 == 0) | (i % 23 == 0), age), i % 17 == 0,
    )
    return rows.select(i.alias("doc_id"), why.alias("problem"))


@query("""
    SELECT user_id, coalesce(max(event_id) FILTER (WHERE value > 50) = max(event_id), FALSE) AS torn,
           CASE WHEN min(event_id) FILTER (WHERE value > 50) < max(event_id) THEN min(event_id) FILTER (WHERE value > 50) END AS damaged_at FROM events GROUP BY user_id
""")
def torn_tails(spark, sf_dir):
    """Logs whose last record is bad, and logs damaged before it."""
    rows = ordered.torn_tail(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 50)
    return rows.select("user_id", F.coalesce("torn", F.lit(False)).alias("torn"), "damaged_at")


@query("SELECT event_id, string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY event_id) AS types FROM events WHERE event_id < 500")
def running_lists(spark, sf_dir):
    """Lists that grow with each checkpoint."""
    rows = table(spark, sf_dir, "events").where("event_id < 500").select("event_id", "user_id", F.array("event_type").alias("types"))
    return ordered.running_lists(rows, ["user_id"], [F.col("event_id")], ["types"]).select("event_id", F.array_join("types", ",").alias("types"))


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE value < 80 GROUP BY user_id")
def latest_checkpoint(spark, sf_dir):
    """The last valid checkpoint of each transfer."""
    return ordered.latest_checkpoint(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") < 80).select("user_id", "event_id")


@query("SELECT doc_id, doc_id % 3 <> 0 AND strlen(text) >= 16 AS finished FROM documents")
def finished_earlier(spark, sf_dir):
    """Transfers whose last checkpoint is the whole file, in its place already (C17)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    n = F.ceil(F.col("size") / 64).cast("int")
    last = F.struct(F.lit("x").alias("sha256"), F.col("size").alias("offset"), F.array_repeat(F.lit("h"), n).alias("chunks"))
    placed = F.when(F.col("doc_id") % 3 != 0, F.col("size"))
    return d.select("doc_id", (resume.finished_earlier(last, F.col("size"), F.lit(64).cast("long"), placed) & (F.col("size") >= 16)).alias("finished"))


@query(ENTRIES_SQL + "SELECT CASE WHEN line_no % 2 = 0 THEN path || '.age' ELSE path END AS path, CASE WHEN line_no % 2 = 0 THEN size + 100 ELSE size END AS size FROM e")
def stored_view(spark, sf_dir):
    """Entries as they lie on tape, half of them encrypted."""
    age = F.struct((F.col("size") + 100).alias("size"), F.col("sha256"), F.array(F.lit("r")).alias("recipients"))
    rows = plain_entries(spark, sf_dir).withColumn("age", F.when(F.col("line_no") % 2 == 0, age))
    return catalog.stored_view(rows).select("path", "size")


@query("SELECT lang || '/' || doc_id AS path, lang = 'en' AS inside, TRUE AS root, FALSE AS relative FROM documents")
def absolute_containment(spark, sf_dir):
    """Whether absolute paths lie within a folder, as cleaned."""
    rows = plain_entries(spark, sf_dir).select("path")
    full = F.concat(F.lit("/./x/..//"), "path", F.lit("/"))
    return rows.select("path", catalog.within(full, F.lit("/en/y/..")).alias("inside"), catalog.within(full, F.lit("/")).alias("root"), catalog.within(full, F.lit("en")).alias("relative"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_found, CASE WHEN count(*) = 1 THEN min(CAST(c_custkey AS VARCHAR)) END AS id FROM customer WHERE c_name = (SELECT min(c_name) FROM customer) OR CAST(c_custkey AS VARCHAR) = '2'")
def ambiguous_lookup(spark, sf_dir):
    """A tape by id or label; an ambiguous name finds none."""
    c = table(spark, sf_dir, "customer")
    first = c.agg(F.min("c_name").alias("n")).first().n
    tapes = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_name") == first, "2").otherwise(F.col("c_name")).alias("label"))
    return catalog.lookup(tapes, "2")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 7 WHEN c_custkey = 1 THEN 99 END AS BIGINT) AS retired_ns, CASE WHEN c_custkey = 1 THEN 'a,b' WHEN c_custkey % 2 = 0 THEN 'a' END AS keys FROM customer")
def tape_updates(spark, sf_dir):
    """A tape retired and its encryption recorded; the first time and the set of keys stay."""
    c = table(spark, sf_dir, "customer")
    held = F.struct(F.lit("aes").alias("method"), F.array(F.lit("a")).alias("keys"), at().alias("since_ns"))
    tapes = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lit(7)).cast("long").alias("retired_ns"), F.when((F.col("c_custkey") % 2 == 0) | (F.col("c_custkey") == 1), held).alias("encryption"))
    tapes = catalog.set_retired(catalog.set_retired(tapes, "1", True, 99), "3", True, 99)
    tapes = catalog.record_encryption(catalog.record_encryption(tapes, "1", "aes", "b", 5), "1", "aes", "b", 6)
    return tapes.select("id", "retired_ns", F.array_join("encryption.keys", ",").alias("keys"))


@query("SELECT source AS tape_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS seq, doc_id AS at_ns FROM documents")
def verification_history(spark, sf_dir):
    """Verifications appended after those there are."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("tape_id"), F.col("doc_id").alias("at_ns"), *(F.lit(0).alias(c) for c in ("files", "verified", "repairable", "failed", "problems")))
    cut = rows.agg(F.max("at_ns").alias("m")).first().m // 2
    none = spark.createDataFrame([], schemas.VERIFICATIONS)
    first = catalog.append_verification(none, rows.where(F.col("at_ns") <= cut))
    return catalog.append_verification(first, rows.where(F.col("at_ns") > cut)).select("tape_id", F.col("seq").cast("long").alias("seq"), "at_ns")


# Scalars


@query("""
    SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE n || ' B' END AS size,
           printf('%02d:%02d:%02d', CAST(s // 3600 AS INTEGER), CAST(s // 60 % 60 AS INTEGER), CAST(s % 60 AS INTEGER)) AS took, CAST(268435456 + o_orderkey * 400 + n // 4194304 * 100 AS BIGINT) AS reserve, CAST(200 + 16 + n + 16 * greatest((n + 65535) // 65536, 1) AS BIGINT) AS sealed
    FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 64 ELSE 4096 END) // 512 * CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS n, CAST(round(o_totalprice) AS BIGINT) AS s FROM orders)
""")
def sizes_and_times(spark, sf_dir):
    """Sizes and durations as text, the metadata reserve, encrypted sizes."""
    k = F.col("o_orderkey")
    n = F.floor(F.round(F.col("o_totalprice") * 100).cast("long") * F.when(k % 3 == 0, 1).when(k % 3 == 1, 64).otherwise(4096) / 512).cast("long") * F.when(k % 5 == 0, 0).otherwise(1)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), F.round("o_totalprice").alias("s"))
    return rows.select("o_orderkey", scalars.format_bytes(F.col("n")).alias("size"), scalars.format_duration(F.col("s")).alias("took"), scalars.metadata_reserve(k, F.col("n")).cast("long").alias("reserve"), scalars.sealed_stored_size(F.col("n"), F.lit(200).cast("long")).cast("long").alias("sealed"))


@query("""
    WITH c AS (SELECT doc_id, source, regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', '?', 'g') AS t FROM documents)
    SELECT doc_id, left(t, CAST(list_max(list_filter(range(0, 129), lambda k: strlen(left(t, k)) <= 128)) AS BIGINT)) AS label, 'a\\x07b' || doc_id || '\\x7f' AS shown,
           CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE source END AS name, CASE doc_id % 3 WHEN 0 THEN 'this tape' WHEN 1 THEN 'tape ' || source ELSE 'tapes A, ' || source END AS places FROM c
""")
def labels_and_names(spark, sf_dir):
    """Labels cleaned and cut, text made safe for a terminal, names of tapes."""
    d = table(spark, sf_dir, "documents")
    i, s = F.col("doc_id"), F.col("source")
    names = F.when(i % 3 == 2, F.array(F.lit("A"), s)).otherwise(F.array(s))
    return d.select(
        "doc_id", validate.clean_label(F.col("text")).alias("label"), scalars.term_safe(F.concat(F.lit("a\x07b"), i.cast("string"), F.lit("\x7f"))).alias("shown"),
        scalars.tape_name(F.when(i % 2 == 0, F.concat(F.lit("T"), i.cast("string"))).otherwise(""), s).alias("name"), scalars.tape_list(names, F.when(i % 3 == 0, s).otherwise("none")).alias("places"),
    )


# Reports


@query("""
    SELECT printf('%-16s  %s  %8d files  %10s  ', CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, CAST(c_custkey AS VARCHAR), c_nationkey, CASE WHEN c_custkey >= 1024 THEN printf('%.1f KiB', c_custkey / 1024.0) ELSE c_custkey || ' B' END)
           || CASE WHEN c_custkey % 5 = 0 THEN 'RETIRED 1970-01-02, ' ELSE '' END
           || CASE WHEN c_custkey % 7 = 0 THEN 'never verified' ELSE 'verified 1970-01-03 ' || CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 > 0 THEN (c_custkey % 3) || ' FAILED, 1 REPAIRABLE' WHEN c_custkey % 3 > 0 THEN (c_custkey % 3) || ' FAILED' WHEN c_custkey % 2 > 0 THEN '1 REPAIRABLE' ELSE 'OK' END END
           || CASE WHEN c_custkey % 8 = 0 THEN ', encrypted (key a, b)' WHEN c_custkey % 4 = 0 THEN ', encrypted' ELSE '' END AS line FROM customer
""")
def tape_report(spark, sf_dir):
    """The line of each cataloged tape."""
    k = F.col("c_custkey")
    keys = F.when(k % 8 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    tapes = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("label"), F.col("c_nationkey").alias("files"), k.alias("bytes"), F.when(k % 5 == 0, 86_400_000_000_000).cast("long").alias("retired_ns"),
        F.when(k % 4 == 0, F.struct(keys.alias("keys"))).alias("encryption"), k,
    )
    seen = tapes.where("c_custkey % 7 <> 0").select(F.col("id").alias("tape_id"), F.lit(2).alias("seq"), F.lit(2 * 86_400_000_000_000).cast("long").alias("at_ns"), (k % 3).alias("failed"), (k % 2).alias("repairable"), F.lit(0).alias("problems"))
    older = tapes.select(F.col("id").alias("tape_id"), F.lit(1).alias("seq"), F.lit(9 * 86_400_000_000_000).cast("long").alias("at_ns"), F.lit(9).alias("failed"), F.lit(0).alias("repairable"), F.lit(0).alias("problems")).where("tape_id % 7 <> 0")
    return reports.tape_lines(tapes, seen.unionByName(older))


@query(ENTRIES_SQL + """
    SELECT sha256 || '  ' || lpad(CAST(size AS VARCHAR), 12, ' ') || '  ' || path || CASE WHEN line_no % 3 = 0 THEN '  (encrypted)' WHEN line_no % 5 = 0 THEN '  (recovered)' WHEN ref_path IS NOT NULL THEN '  -> ' || tape_id || ':' || ref_path ELSE '' END AS line FROM e WHERE starts_with(path, 'en/')
    UNION ALL SELECT 'Files: ' || count(*) || '  Bytes: ' || CASE WHEN sum(size) >= 1048576 THEN printf('%.1f MiB', sum(size) / 1048576.0) WHEN sum(size) >= 1024 THEN printf('%.1f KiB', sum(size) / 1024.0) ELSE sum(size) || ' B' END FROM e WHERE starts_with(path, 'en/')
""")
def listing_report(spark, sf_dir):
    """A folder's listing with its totals."""
    age = F.struct(F.col("size"), F.col("sha256"), F.array(F.lit("r")).alias("recipients"))
    rows = entries(spark, sf_dir).withColumn("recovered", F.col("line_no") % 5 == 0).withColumn("age", F.when(F.col("line_no") % 3 == 0, age))
    lines, total = reports.listing(rows, "en")
    return lines.unionByName(total)


@query("""
    SELECT event_id, '[' || repeat('=', CAST(floor(event_id / m * 32) AS INTEGER)) || repeat(' ', CAST(32 - floor(event_id / m * 32) AS INTEGER)) || '] ' || printf('%3.0f', event_id / m * 100) || '%  ' || CASE WHEN event_id // 10 >= 1024 THEN printf('%.1f KiB', event_id // 10 / 1024.0) ELSE (event_id // 10) || ' B' END || '/s' AS line
    FROM events, (SELECT max(event_id) + 1 AS m FROM events)
""")
def progress_lines(spark, sf_dir):
    """Progress of a transfer: bar, share, rate."""
    e = table(spark, sf_dir, "events")
    total = (e.agg(F.max("event_id").alias("m")).first().m or 0) + 1
    return e.select("event_id", reports.progress_line(F.col("event_id"), F.lit(total), F.lit(10.0)).alias("line"))


@query("SELECT path, row_number() OVER (ORDER BY CAST(substring(path, 8) AS INTEGER), path) AS place FROM (SELECT DISTINCT '/dev/sg' || user_id AS path FROM events)")
def drive_order(spark, sf_dir):
    """Drives by the number of their device."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("/dev/sg"), F.col("user_id").cast("string")).alias("path")).distinct()
    return ordered.numbered(rows, ordered.drive_order())
