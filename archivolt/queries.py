"""Registered queries of the archive operators over the driver's tables, and their DuckDB equivalents.

documents stands for an archive: tape = source, path = lang/doc_id, size = UTF-8 bytes, order = doc_id; a row whose content is on
its tape already is a reference to the first. labels are verifications, events telemetry, orders a write log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import schemas
from archivolt.functions.scalars import file_key
from archivolt.functions.validate import valid_path
from archivolt.operators import catalog, content, ordered, parity, telemetry
from archivolt.plans import purge, put, tape
from archivolt.sinks import checksum_lines
from archivolt.sources.jsonl import parsed

ORACLE_SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The archive in SQL: e are the entries, with the reference as ref_path.
ENTRIES_SQL = """
    WITH d AS (SELECT source AS tape_id, lang || '/' || doc_id AS path, doc_id AS line_no, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents),
    f AS (SELECT *, first_value(path) OVER (PARTITION BY tape_id, sha256 ORDER BY line_no) AS head FROM d),
    e AS (SELECT tape_id, path, line_no, size, sha256, CASE WHEN head <> path THEN head END AS ref_path FROM f)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    return docs.select(F.col("source").alias("tape_id"), F.lit(1).alias("segment"), path.alias("path"), F.col("doc_id").alias("line_no"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plain_entries() with ref: a content's later rows on a tape refer to its first. The first is a partial aggregate joined back, not a window, so a content with very many rows isn't sorted in one task."""
    rows = plain_entries(spark, sf_dir)
    first = rows.groupBy("tape_id", "sha256").agg(F.min_by("path", "line_no").alias("head"))
    rows = rows.join(first, ["tape_id", "sha256"])
    ref = F.when(F.col("head") != F.col("path"), F.struct(F.col("tape_id").alias("tape"), F.col("head").alias("path")))
    return rows.select("tape_id", "segment", "path", "line_no", "size", "sha256", ref.alias("ref"), F.lit(None).cast(schemas.AGE).alias("age"))


@query("SELECT sha256(text) AS sha256, count(DISTINCT source) AS tapes, count(*) AS files FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def copies_on_tapes(spark, sf_dir):
    """Content on at least two tapes (A3)."""
    rows = plain_entries(spark, sf_dir).groupBy("sha256", "tape_id").agg(F.count("*").alias("n"))
    return rows.groupBy("sha256").agg(F.count("*").alias("tapes"), F.sum("n").alias("files")).where("tapes >= 2")


@query(ENTRIES_SQL + "SELECT tape_id, path, size, sha256, substring(sha256(path), 1, 32) AS file_key FROM e")
def content_hash(spark, sf_dir):
    """Content hash and file key."""
    return plain_entries(spark, sf_dir).select("tape_id", "path", "size", "sha256", file_key(F.col("path")).alias("file_key"))


@query("""
    SELECT doc_id, CAST(i AS INTEGER) AS chunk, sha256(unhex(substring(hex(encode(text)), i * 512 + 1, 512))) AS sha256
    FROM documents, unnest(range(0, (strlen(text) + 255) // 256)) AS t(i)
""")
def chunk_hashes(spark, sf_dir):
    """Hash of each 256-byte piece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return content.chunk_hashes(docs, ["doc_id"], "content", 256)


@query(ENTRIES_SQL + "SELECT sha256, count(DISTINCT tape_id) AS copies, string_agg(DISTINCT tape_id, ',' ORDER BY tape_id) AS tape_ids FROM e WHERE ref_path IS NULL GROUP BY sha256")
def copy_index(spark, sf_dir):
    """Copies of each content (A3, A5)."""
    return catalog.copy_index(entries(spark, sf_dir)).select("sha256", "copies", F.array_join("tape_ids", ",").alias("tape_ids"))


@query(ENTRIES_SQL + "SELECT size, count(*) AS files FROM e WHERE ref_path IS NULL GROUP BY size HAVING count(*) > 1")
def size_candidates(spark, sf_dir):
    """Sizes that several contents share: only their files need hashing."""
    return catalog.size_index(entries(spark, sf_dir)).where("files > 1")


@query(ENTRIES_SQL + "SELECT tape_id, count(*) AS files, CAST(coalesce(sum(size) FILTER (WHERE ref_path IS NULL), 0) AS BIGINT) AS bytes FROM e GROUP BY tape_id")
def tape_totals(spark, sf_dir):
    """Files and content bytes of each tape (A1)."""
    return catalog.tape_totals(entries(spark, sf_dir))


@query(ENTRIES_SQL + "SELECT tape_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY tape_id")
def list_totals(spark, sf_dir):
    """A listing's totals, references included (A2)."""
    return catalog.list_totals(entries(spark, sf_dir), ["tape_id"])


@query(ENTRIES_SQL + "SELECT tape_id, path, sha256 FROM e WHERE contains(lower(path), 'en/1')")
def search_path(spark, sf_dir):
    """Search by path, whatever the case."""
    return catalog.search(plain_entries(spark, sf_dir), "EN/1").select("tape_id", "path", "sha256")


@query(ENTRIES_SQL + "SELECT tape_id, path, sha256 FROM e WHERE starts_with(sha256, 'ab') OR contains(lower(path), 'ab')")
def search_hash(spark, sf_dir):
    """Search by the start of a hash."""
    return catalog.search(plain_entries(spark, sf_dir), "AB").select("tape_id", "path", "sha256")


@query(ENTRIES_SQL + "SELECT tape_id, path, size FROM e WHERE path = 'de' OR starts_with(path, 'de/')")
def subtree(spark, sf_dir):
    """Files below a folder."""
    rows = plain_entries(spark, sf_dir)
    return rows.where(catalog.in_subtree(F.col("path"), "/de/")).select("tape_id", "path", "size")


@query(ENTRIES_SQL + """
    SELECT a.tape_id, a.path, coalesce(string_agg(DISTINCT b.tape_id, ',' ORDER BY b.tape_id), '') AS other_tapes
    FROM e a LEFT JOIN e b ON a.sha256 = b.sha256 AND a.tape_id <> b.tape_id GROUP BY 1, 2
""")
def other_copies(spark, sf_dir):
    """Other tapes with a file's content."""
    return catalog.other_copies(entries(spark, sf_dir)).select("tape_id", "path", F.array_join("other_tapes", ",").alias("other_tapes"))


@query(ENTRIES_SQL + """
    SELECT a.tape_id, a.path, a.ref_path, b.size AS target_size FROM e a JOIN e b
    ON a.tape_id = b.tape_id AND a.ref_path = b.path AND b.ref_path IS NULL AND a.sha256 = b.sha256
""")
def ref_resolve(spark, sf_dir):
    """References followed once."""
    rows = entries(spark, sf_dir)
    target = rows.where("ref is null").select(F.col("tape_id").alias("t"), F.col("path").alias("p"), F.col("sha256").alias("s"), F.col("size").alias("target_size"))
    on = (F.col("ref.tape") == F.col("t")) & (F.col("ref.path") == F.col("p")) & (F.col("sha256") == F.col("s"))
    return rows.join(target, on).select("tape_id", "path", F.col("ref.path").alias("ref_path"), "target_size")


@query("SELECT lang || '/' || doc_id AS path, 'ORPHAN' AS decision FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    """Files on tape that no record names (J10, Q4): documents without a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.lit(True).alias("regular"), F.lit(None).cast("long").alias("block"))
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    known = known.select("path", F.lit(0).cast("long").alias("size"), F.lit("").alias("sha256"), F.lit(None).cast(schemas.AGE).alias("age"))
    return tape.recover(docs.drop("doc_id"), known).select("path", "decision")


@query(ENTRIES_SQL + """
    , o AS (SELECT path, size, sha256, first_value(path) OVER (PARTITION BY sha256 ORDER BY string_split(path, '/')) AS head FROM e)
    SELECT path, size, CASE WHEN head = path THEN 'ARCHIVE' ELSE 'DUPLICATE' END AS decision, CASE WHEN head <> path THEN head END AS ref_path FROM o
""")
def dedup_plan(spark, sf_dir):
    """An archiving run over all files, in walk order, onto an empty tape."""
    files = plain_entries(spark, sf_dir).select(F.col("path").alias("rel"), F.col("path").alias("source"), "size", F.lit(0).cast("long").alias("mtime_ns"), "sha256")
    none = spark.createDataFrame([], schemas.ENTRIES)
    planned = put.decide(files, none, none, none, spark.createDataFrame([], schemas.TAPES), "new")
    return planned.select(F.col("rel").alias("path"), "size", "decision", "ref_path")


@query(ENTRIES_SQL + "SELECT sha256 || '  ' || path AS line FROM e WHERE ref_path IS NULL")
def checksum_list(spark, sf_dir):
    """The checksum list of what lies on tape."""
    return checksum_lines(entries(spark, sf_dir)).withColumnRenamed("value", "line")


@query(ENTRIES_SQL + """
    , s AS (SELECT e.*, CASE WHEN l.doc_id IS NULL THEN 'failed' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'OK' ELSE 'repairable' END AS status
            FROM e LEFT JOIN labels l ON e.line_no = l.doc_id)
    SELECT tape_id, count(*) AS files, count(*) FILTER (WHERE ref_path IS NOT NULL) AS refs,
           count(*) FILTER (WHERE ref_path IS NULL AND status = 'OK') AS verified, count(*) FILTER (WHERE ref_path IS NULL AND status = 'repairable') AS repairable,
           count(*) FILTER (WHERE ref_path IS NULL AND status = 'failed') AS failed,
           CAST(coalesce(sum(size) FILTER (WHERE ref_path IS NULL AND status = 'OK'), 0) AS BIGINT) AS bytes FROM s GROUP BY tape_id
""")
def verify_summary(spark, sf_dir):
    """Verification totals of each tape."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("line_no"), "quality", "toxic")
    rows = entries(spark, sf_dir).join(labels, "line_no", "left")
    status = F.when(F.col("toxic").isNull() | (F.col("toxic") == 1), "failed").when(F.col("quality") == 1, "OK").otherwise("repairable")
    return content.verify_summary(rows.withColumn("status", status), ["tape_id"])


@query(ENTRIES_SQL + """
    , v AS (SELECT d.source AS tape_id, arg_max(l.toxic, l.doc_id) = 0 AS ok FROM labels l JOIN documents d USING (doc_id) GROUP BY 1),
    r AS (SELECT e.sha256 AS path, e.size, e.tape_id, e.line_no, coalesce(v.ok, FALSE) AS ok FROM e LEFT JOIN v USING (tape_id)),
    n AS (SELECT path, max(size) AS size, count(DISTINCT tape_id) FILTER (WHERE ok) AS n, string_agg(DISTINCT tape_id, ', ' ORDER BY tape_id) FILTER (WHERE ok) AS names,
                 arg_max(tape_id, (tape_id, line_no)) FILTER (WHERE NOT ok) AS last_bad FROM r GROUP BY path),
    k AS (SELECT path, tape_id, row_number() OVER (PARTITION BY path ORDER BY tape_id, line_no) AS rank
          FROM (SELECT path, tape_id, min(line_no) AS line_no FROM r WHERE ok GROUP BY path, tape_id)),
    t AS (SELECT path, string_agg(tape_id, ', ' ORDER BY tape_id) AS names FROM k WHERE rank <= 2 GROUP BY path)
    SELECT path, size, CASE WHEN n >= 2 THEN 'DELETE' ELSE 'KEEP' END AS decision,
           CASE WHEN n >= 2 THEN NULL WHEN n = 1 THEN 'only 1 of 2 required verified copies (' || n.names || ')'
                ELSE 'tape ' || last_bad || ' has not passed verification since archiving' END AS reason, coalesce(t.names, '') AS tapes
    FROM n LEFT JOIN t USING (path)
""")
def purge_plan(spark, sf_dir):
    """Which contents are on two tapes whose last verification passed, and why the others stay."""
    rows = entries(spark, sf_dir).withColumn("archived_at_ns", F.lit(-1).cast("long")).withColumn("mtime_ns", F.lit(0).cast("long"))
    written = rows.withColumn("source", F.col("sha256"))
    files = rows.groupBy(F.col("sha256").alias("path")).agg(F.max("size").alias("size")).withColumn("mtime_ns", F.lit(0).cast("long"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tape_id"))
    seen = table(spark, sf_dir, "labels").join(docs, "doc_id").select("tape_id", F.col("doc_id").alias("seq"), F.col("doc_id").alias("at_ns"), F.col("toxic").cast("int").alias("failed"), F.lit(0).alias("repairable"), F.lit(0).alias("problems"))
    tapes = rows.select(F.col("tape_id").alias("id")).distinct().withColumn("label", F.lit("")).withColumn("retired_ns", F.lit(None).cast("long"))
    planned = purge.plan(files, written, rows, tapes, seen, copies=2)
    return planned.select("path", "size", "decision", "reason", F.array_join("tapes", ", ").alias("tapes"))


@query("""
    WITH i AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events),
    s AS (SELECT event_type, min(event_id) AS lo, max(event_id) AS hi FROM i GROUP BY event_type, island)
    SELECT event_type, string_agg((lo * 16) || '-' || (least((hi + 1) * 16, (SELECT max(event_id) * 16 + 10 FROM events)) - 1), ', ' ORDER BY lo) AS ranges FROM s GROUP BY event_type
""")
def bad_ranges(spark, sf_dir):
    """Consecutive bad chunks as byte ranges (W1): events of one type as the bad chunks of a file that ends within the last."""
    events = table(spark, sf_dir, "events")
    size = (events.agg(F.max("event_id").alias("m")).first().m or 0) * 16 + 10
    return ordered.bad_ranges(events, ["event_type"], "event_id", F.lit(16).cast("long"), F.lit(size).cast("long"))


@query("""
    WITH c AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS n FROM events),
    w AS (SELECT *, first_value(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS base, lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM c)
    SELECT event_id, CASE WHEN n >= base THEN n - base END AS n_since, CASE WHEN n >= before THEN n - before END AS n_step FROM w
""")
def counter_delta(spark, sf_dir):
    """Rises of a counter over its baseline and over the poll before."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("n"))
    order = [F.col("ts"), F.col("event_id")]
    rows = ordered.since_previous(ordered.since_baseline(rows, ["user_id"], order, ["n"]), ["user_id"], order, ["n"])
    return rows.select("event_id", "n_since", "n_step")


@query("""
    WITH w AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
    SELECT event_id, was, event_type AS now FROM w WHERE was <> event_type
""")
def rate_changes(spark, sf_dir):
    """Each change of a state."""
    rows = ordered.changes(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return rows.select("event_id", "was", F.col("event_type").alias("now"))


@query("""
    WITH RECURSIVE o AS (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    r AS (SELECT source, rn, doc_id, CASE WHEN size >= 40000 THEN 0 ELSE size END AS held, 1 AS segment, CASE WHEN size >= 40000 THEN 2 ELSE 1 END AS following FROM o WHERE rn = 1
          UNION ALL
          SELECT o.source, o.rn, o.doc_id, CASE WHEN r.held + o.size >= 40000 THEN 0 ELSE r.held + o.size END, r.following, CASE WHEN r.held + o.size >= 40000 THEN r.following + 1 ELSE r.following END
          FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1)
    SELECT source AS tape_id, doc_id AS line_no, CAST(segment AS INTEGER) AS segment FROM r
""")
def segment_flush(spark, sf_dir):
    """Segments of each tape's records, flushed at 40,000 bytes."""
    rows = plain_entries(spark, sf_dir).select("tape_id", "line_no", "size")
    return ordered.flush_segments(rows, ["tape_id"], "line_no", "size", 40_000).select("tape_id", "line_no", "segment")


@query("""
    WITH c AS (SELECT o_orderkey, o_orderpriority, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS need FROM orders)
    SELECT o_orderkey, o_orderpriority FROM c WHERE need <= 5000000000
""")
def prefix_fit(spark, sf_dir):
    """What fits in order before the first that doesn't."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("need"))
    return ordered.prefix_that_fits(rows, ["o_orderpriority"], [F.col("o_orderkey")], F.col("need"), F.lit(5_000_000_000)).select("o_orderkey", "o_orderpriority")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    """The last record of each key."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ordered.last_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def first_wins(spark, sf_dir):
    """The first record of each key."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ordered.first_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
    WITH w AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
    SELECT event_id, was IS NULL OR was <> event_type AS starts FROM w
""")
def group_starts(spark, sf_dir):
    """Where a group begins in an ordered scan."""
    rows = ordered.group_starts(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return rows.select("event_id", "starts")


#: Events as a drive's error log: the sense of each event type.
ERRORS_SQL = """
    WITH g AS (SELECT event_id, CAST(user_id AS VARCHAR) AS medium, event_type, CASE WHEN value > 50 THEN 3 ELSE 4 END AS key,
                      CASE WHEN event_type < 'd' THEN 'unrecovered read error' ELSE 'write error' END AS kind FROM events)
"""


def error_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("drive").alias("drive"), F.col("event_id").alias("ord"), F.when(F.col("value") > 50, 3).otherwise(4).alias("key"), F.when(F.col("event_type") < "d", 0x11).otherwise(0x0C).alias("asc"),
        F.lit(0).alias("ascq"), F.col("user_id").cast("string").alias("medium_id"), F.when(F.col("value") > 90, "old").otherwise("new").alias("firmware"),
    )


@query(ERRORS_SQL + """
    , k AS (SELECT medium, kind, min(event_id) AS seen, count(*) AS n FROM g WHERE key = 3 GROUP BY 1, 2)
    SELECT medium, CAST(sum(n) AS BIGINT) AS errors, string_agg(kind, ', ' ORDER BY seen) AS kinds FROM k GROUP BY medium
""")
def error_analysis(spark, sf_dir):
    """Medium errors of each cartridge, kinds in the order first seen."""
    return telemetry.medium_errors(error_rows(spark, sf_dir), ["drive"]).select("medium", "errors", F.array_join("kinds", ", ").alias("kinds"))


@query("""
    SELECT 'drive' AS drive, count(DISTINCT user_id) FILTER (WHERE value > 50) AS media, count(*) FILTER (WHERE value > 50) AS medium_errors,
           count(DISTINCT user_id) FILTER (WHERE value > 50) >= 3 AS drive_suspected, count(*) FILTER (WHERE NOT coalesce(value > 50, FALSE)) AS hardware_errors,
           count(*) FILTER (WHERE value > 90) AS older_entries FROM events
""")
def drive_suspicion(spark, sf_dir):
    """Whether the error history points to the drive."""
    return telemetry.analyse_errors(error_rows(spark, sf_dir), ["drive"], "new").drop("older_levels")


@query("""
    WITH s AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) > 0),
    l AS (SELECT doc_id, size, size >= 1280 AS large, CASE WHEN size >= 1280 THEN 64 ELSE (size + 19) // 20 END AS shard FROM s),
    c AS (SELECT *, (size + shard - 1) // shard AS chunks FROM l),
    w AS (SELECT *, (chunks - 1) // 320 AS last, least((least(320, chunks - ((chunks - 1) // 320) * 320) + 19) // 20, 16) AS stripes FROM c)
    SELECT doc_id, CASE WHEN large THEN 'rs-window' ELSE 'rs-small' END AS scheme, CAST(shard AS BIGINT) AS shard_size, CAST(chunks AS BIGINT) AS chunks,
           CAST(CASE WHEN large THEN last * 32 + stripes * 2 ELSE 2 END AS BIGINT) AS parity_shards,
           CAST(CASE WHEN large THEN (chunks - 1 - last * 320) % stripes END AS BIGINT) AS last_stripe, CAST(CASE WHEN large THEN (chunks - 1 - last * 320) // stripes END AS BIGINT) AS last_pos FROM w
""")
def parity_geometry(spark, sf_dir):
    """Layouts and shard places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", parity.layout(F.octet_length("text").cast("long"), F.lit(64).cast("long"), F.lit(2)).alias("layout")).where("layout is not null")
    x, last = F.col("layout"), parity.chunk_count(F.col("layout")) - 1
    large = x["scheme"] == parity.WINDOW
    return docs.select(
        "doc_id", "layout.scheme", "layout.shard_size", (last + 1).alias("chunks"), parity.parity_shards(x).alias("parity_shards"),
        F.when(large, parity.stripe_of(x, last)).alias("last_stripe"), F.when(large, parity.position_of(x, last)).alias("last_pos"),
    )


@query("""
    WITH s AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS size FROM documents WHERE strlen(text) > 0),
    l AS (SELECT *, size >= 20480 AS large, CASE WHEN size >= 20480 THEN 1024 ELSE (size + 19) // 20 END AS shard FROM s),
    c AS (SELECT *, (size + shard - 1) // shard AS chunks FROM l),
    i AS (SELECT *, unnest(range(0, chunks)) AS i FROM c),
    w AS (SELECT *, CASE WHEN large THEN i // 320 ELSE 0 END AS win, CASE WHEN large THEN i % 320 ELSE i END AS k FROM i),
    p AS (SELECT *, CASE WHEN large THEN least((least(320, chunks - win * 320) + 19) // 20, 16) ELSE 1 END AS stripes FROM w)
    SELECT doc_id, CAST(win AS BIGINT) AS win, CAST(CASE WHEN large THEN k % stripes ELSE 0 END AS BIGINT) AS stripe, CAST(k // stripes AS BIGINT) AS pos, TRUE AS ok, sha256(unhex(substring(h, i * shard * 2 + 1, shard * 2))) AS sha256
    FROM p WHERE k // stripes IN (0, 3)
""")
def parity_roundtrip(spark, sf_dir):
    """Every file encoded with two parity shards a stripe, two data shards of each stripe lost; the hashes of those rebuilt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    docs = docs.withColumn("layout", parity.layout(F.octet_length("content").cast("long"), F.lit(1024).cast("long"), F.lit(2)))
    shards = parity.split_chunks(docs, ["doc_id"]).withColumn("wanted", F.sha2("shard", 256))
    coded = parity.encode(shards.drop("wanted"), ["doc_id"])
    lost = shards.withColumn("shard", F.when(~F.col("pos").isin(0, 3), F.col("shard")))
    fixed = parity.repair(lost, coded, ["doc_id"])
    return fixed.select("doc_id", F.col("window").alias("win"), "stripe", "pos", "ok", F.sha2("shard", 256).alias("sha256"))


@query("""
    SELECT event_id, 0 AS ord, 3 AS code, CAST(user_id AS BIGINT) AS n FROM events
    UNION ALL SELECT event_id, 1, 6, CAST(floor(abs(value)) AS BIGINT) FROM events
""")
def log_page_parse(spark, sf_dir):
    """Log pages cut into parameters (B1, B3, F10): each event as a page of two counters and a torn third parameter."""
    e = table(spark, sf_dir, "events")
    wide = lambda c: F.lpad(F.hex(c.cast("long")), 16, "0")
    raw = F.unhex(F.concat(F.lit("0200FFFF"), F.lit("00030008"), wide(F.col("user_id")), F.lit("00060008"), wide(F.floor(F.abs("value"))), F.lit("0005000811")))
    rows = telemetry.log_params(e.select("event_id", raw.alias("raw")), ["event_id"])
    return rows.select("event_id", "ord", "code", telemetry.be_uint(F.col("value")).cast("long").alias("n"))


@query("""
    SELECT source, count(*) FILTER (WHERE strlen(text) % 7 <> 0) AS good, count(*) FILTER (WHERE strlen(text) % 7 = 0) AS bad FROM documents GROUP BY source
""")
def jsonl_lenient(spark, sf_dir):
    """Records as JSON lines, some cut short: good ones are kept, bad ones counted."""
    rows = plain_entries(spark, sf_dir).select(F.col("tape_id").alias("file"), "line_no", "size", F.to_json(F.struct("path", "size", "sha256")).alias("line"))
    cut = F.when(F.col("size") % 7 == 0, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    found = parsed(rows.select("file", "line_no", cut.alias("line")), schemas.ENTRY_LINE)
    return found.groupBy(F.col("file").alias("source")).agg(F.count_if(F.col("problem").isNull()).alias("good"), F.count_if(F.col("problem").isNotNull()).alias("bad"))


@query("""
    SELECT doc_id, text <> '' AND NOT regexp_matches(text, '(^|/)[.]{0,2}(/|$)') AND NOT regexp_matches(text, '[\\n\\r]') AND NOT contains(text, chr(0)) AND text <> '.archive' AND NOT starts_with(text, '.archive/') AND text <> 'SHA256SUMS' AS ok
    FROM documents
""")
def path_rules(spark, sf_dir):
    """Which whole texts would be accepted as a path."""
    return table(spark, sf_dir, "documents").select("doc_id", valid_path(F.col("text")).alias("ok"))


@query("""
    WITH p AS (SELECT lang || CASE WHEN doc_id % 3 = 0 THEN '-x/' WHEN doc_id % 3 = 1 THEN '/' ELSE '/a/' END || doc_id AS path FROM documents)
    SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM p
""")
def walk_order(spark, sf_dir):
    """Place of each file in a directory walk (O7): folders before those whose name goes on with a sign below the slash."""
    i = F.col("doc_id")
    path = F.concat("lang", F.when(i % 3 == 0, "-x/").when(i % 3 == 1, "/").otherwise("/a/"), i.cast("string"))
    return ordered.numbered(table(spark, sf_dir, "documents").select(path.alias("path")), [ordered.walk_order("path")])


from archivolt import device_queries, plan_queries  # noqa: E402, F401  they register their queries
