"""Catalog queries, content checks, parity and planners on small tapes."""

import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt import schemas
from archivolt.operators import catalog, content, parity
from archivolt.plans import purge, put, tape

A, B = "a" * 64, "b" * 64


def entries(spark, rows):
    """rows: (tape_id, path, size, sha, ref or None, mtime)"""
    data = [(t, 1, i, p, s, h, m, f"/src/{p}", 10, r, False, None) for i, (t, p, s, h, r, m) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.ENTRIES)


def tape_rows(spark, rows):
    return spark.createDataFrame([(i, lab, None, 0, 0, 0, 0, ret, None) for i, lab, ret in rows], schemas.TAPES)


@pytest.fixture
def two(spark):
    e = entries(spark, [("t1", "iso/Ubuntu.iso", 10, A, None, 1), ("t1", "x", 3, B, None, 1), ("t2", "old/ubuntu_2", 20, A, None, 1), ("t2", "ref", 10, A, ("t1", "iso/Ubuntu.iso"), 1)])
    return e, tape_rows(spark, [("t1", "B-TAPE", None), ("t2", "A-TAPE", None)])


def test_catalog(spark, two):
    e, t = two
    assert [r.label for r in catalog.tapes_in_order(t).collect()] == ["A-TAPE", "B-TAPE"]
    assert {r.tape_id: (r.files, r.bytes) for r in catalog.tape_totals(e).collect()} == {"t1": (2, 13), "t2": (2, 20)}
    assert {r.tape_id: r.bytes for r in catalog.list_totals(e, ["tape_id"]).collect()} == {"t1": 13, "t2": 30}
    assert catalog.search(e, "UBUNTU").count() == 2 and catalog.search(e, "bbbbbbbb").count() == 1 and catalog.search(e, "_").count() == 1
    index = {r.sha256: r.copies for r in catalog.copy_index(e, t).collect()}
    assert index == {A: 2, B: 1}
    retired = catalog.set_retired(t, "t1", True, 5)
    assert {r.sha256: r.copies for r in catalog.copy_index(e, retired).collect()} == {A: 1}
    assert catalog.lookup(t, "A-TAPE").first().id == "t2" and catalog.lookup(t, "none").first().n_found == 0
    assert {r.size: r.files for r in catalog.size_index(e).collect()} == {10: 1, 3: 1, 20: 1}
    assert catalog.all_hits(t, e).count() == 4
    once = catalog.record_encryption(catalog.record_encryption(t, "t1", "LTO", "k1", 5), "t1", "LTO", "k2", 9).where("id = 't1'").first()
    assert once.encryption["keys"] == ["k1", "k2"] and once.encryption["since_ns"] == 5


def test_the_last_verification_counts_not_the_latest(spark):
    v = spark.createDataFrame([("t", 1, 100, 1, 1, 0, 0, 0), ("t", 2, 50, 1, 0, 0, 1, 0)], schemas.VERIFICATIONS)
    assert catalog.last_verification(v).first().verified_ok is False
    assert catalog.append_verification(v, v.where("seq = 1").drop("seq").withColumn("seq", F.lit(0).cast("long"))).agg(F.max("seq")).first()[0] == 3


def test_identifying_a_tape(spark, two):
    e, t = two
    mine = e.where("tape_id = 't1'")
    assert [r.id for r in catalog.find_tape(None, mine, t, e).collect()] == ["t1"]
    assert catalog.find_tape("12345678-1234-1234-1234-123456789ABC", mine, t, e).isEmpty()
    assert tape.repair_volume(None, None, mine, t, e, False, True).first().decision == "REPAIR"
    assert tape.repair_volume(None, "t2", mine, t, e, False, True).first().reason == "the files on this tape do not match"
    assert tape.repair_volume(None, None, mine, t, e, True, True).first().decision == "REFUSE"


def test_chunks_and_damage(spark):
    raw = bytes(random.Random(3).randbytes(1000))
    want = [sha256(raw[i : i + 16]).hexdigest() for i in range(0, 1000, 16)]
    one = spark.createDataFrame([("f", bytearray(raw))], "path string, content binary")
    assert [r.sha256 for r in content.chunk_hashes(one, ["path"], "content", 16).orderBy("chunk").collect()] == want and len(want) == 63
    bad = bytearray(raw)
    bad[40] ^= 1
    files = {"f": bytearray(raw), "flip": bad, "cut": bytearray(raw[:500]), "long": bytearray(raw + b"x")}
    e = spark.createDataFrame([(n, 1000, sha256(raw).hexdigest(), 16, want) for n in [*files, "huge"]], "path string, size long, sha256 string, chunk_size long, chunk_sha256 array<string>")
    e = e.withColumn("size", F.when(F.col("path") == "huge", F.lit(1 << 40)).otherwise(F.col("size")))
    got = content.scan(e, spark.createDataFrame([*files.items(), ("huge", bytearray(b"12345"))], "path string, content binary"), ["path"])
    told = {r.path: (r.status, r.detail) for r in content.describe_damage(got, ["path"]).withColumn("status", content.verify_status(F.lit(False))).collect()}
    assert told["f"] == ("OK", None) and told["flip"] == ("failed", "damaged bytes: 32-47") and told["long"][0] == "failed"
    assert told["cut"] == ("failed", "file is cut short, bytes 496-999 missing") and told["huge"][0] == "failed"


def test_parity_percent(spark):
    df = spark.createDataFrame([(p,) for p in (0, 5, 10, 12, 25, -1, 26)], "p int")
    assert [r[0] for r in df.select(parity.shards_for(F.col("p"))).collect()] == [0, 1, 2, 3, 5, None, None]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 5), st.integers(1, 40), st.randoms(use_true_random=False))
def test_stripes_are_rebuilt_within_m_and_refused_beyond(present, m, size, r):
    data = [r.randbytes(size) for _ in range(present)]
    par = dict(enumerate(parity.encode_stripe(data, 20, m, size)))
    lost = r.sample(range(present), min(present, r.randrange(0, m + 2)))
    gone = r.sample(range(m), r.randrange(0, m + 1))
    good, sound = {i: d for i, d in enumerate(data) if i not in lost}, {j: p for j, p in par.items() if j not in gone}
    if len(lost) <= len(sound):
        assert parity.repair_stripe(good, sound, present, 20, m, size) == {i: data[i] for i in lost}
    else:
        with pytest.raises(ValueError):
            parity.repair_stripe(good, sound, present, 20, m, size)


def test_a_burst_is_repaired(spark):
    raw = bytearray(random.Random(5).randbytes(16 * 320 * 3 + 16 * 160 + 7))
    df = spark.createDataFrame([("f", raw), ("small", raw[:200])], "path string, content binary").withColumn("layout", parity.layout(F.octet_length("content").cast("long"), F.lit(16).cast("long"), F.lit(2)))
    shards = parity.split_chunks(df, ["path"]).withColumn("wanted", F.sha2("shard", 256))
    coded = parity.encode(shards.drop("wanted"), ["path"])
    burst = shards.withColumn("shard", F.when(~F.col("chunk").between(340, 371) | (F.col("path") != "f"), F.col("shard")))
    got = parity.repair(burst, coded, ["path"]).collect()
    assert len(got) == 32 and all(r.ok for r in got)
    more = shards.withColumn("shard", F.when(~F.col("chunk").between(320, 352) | (F.col("path") != "f"), F.col("shard")))
    assert not all(r.ok for r in parity.repair(more, coded, ["path"]).collect())
    tail = shards.withColumn("shard", F.when(F.col("path") == "f", F.col("shard")).when(F.col("pos") < 18, F.col("shard")))
    assert all(r.ok for r in parity.repair(tail, coded, ["path"]).collect())
    spoilt = coded.withColumn("parity", F.when(F.col("j") == 0, F.lit(b"x")).otherwise(F.col("parity")))
    assert not any(r.ok for r in parity.repair(tail, spoilt, ["path"]).collect())


def files_of(spark, rows):
    return spark.createDataFrame([(p, f"/src/{p}", s, m, h) for p, s, m, h in rows], "rel string, source string, size long, mtime_ns long, sha256 string")


def test_put_decisions(spark):
    none = entries(spark, [])
    files = files_of(spark, [("a", 5, 1, A), ("b", 5, 1, B), ("copy", 5, 9, A)])
    plan = lambda *a, **k: {r.rel: (r.decision, r.ref_path) for r in put.decide(*a, **k).collect()}
    t1 = tape_rows(spark, [("t1", "", None)])
    assert plan(files, none, none, none, t1, "t1") == {"a": ("ARCHIVE", None), "b": ("ARCHIVE", None), "copy": ("DUPLICATE", "a")}
    assert plan(files, none, none, none, t1, "t1", least=6)["copy"] == ("ARCHIVE", None)
    on1 = entries(spark, [("t1", "a", 5, A, None, 1), ("t1", "b", 5, B, None, 2)])
    assert plan(files, on1, on1, on1, t1, "t1") == {"a": ("SKIP_HERE", None), "b": ("CONFLICT", None), "copy": ("DUPLICATE", "a")}
    t12 = tape_rows(spark, [("t1", "", None), ("t2", "", None)])
    got = plan(files, none, on1, on1, t12, "t2")
    assert got["a"] == ("SKIP_ELSEWHERE", None) and got["b"] == ("DUPLICATE", "b") and got["copy"] == ("DUPLICATE", "a")
    assert plan(files, none, on1, on1, t12, "t2", copies=2) == {"a": ("ARCHIVE", None), "b": ("ARCHIVE", None), "copy": ("DUPLICATE", "a")}


def test_a_copy_that_this_run_writes_counts(spark):
    files = files_of(spark, [("a", 5, 1, A), ("b", 5, 1, A)])
    on1 = entries(spark, [("t1", "b", 5, A, None, 1)])
    got = {r.rel: r.decision for r in put.decide(files, entries(spark, []), on1, on1, tape_rows(spark, [("t1", "", None), ("t2", "", None)]), "t2", copies=2).collect()}
    assert got == {"a": "ARCHIVE", "b": "SKIP_ELSEWHERE"}


def test_paths_within_folders(spark):
    cases = [("/a/b", "/a", True), ("/a", "/a", True), ("/ab", "/a", False), ("/a/../b", "/a", False), ("/a/./b//c", "/a/b/", True), ("a/b", "/a", False), ("/x", "/", True), ("a", ".", True), ("../a", ".", False), ("../a/b", "../a", True), ("/..", "/", True), ("/a", "a", False)]
    got = spark.createDataFrame(cases, "p string, f string, want boolean").select("p", "f", "want", catalog.within(F.col("p"), F.col("f")).alias("got")).collect()
    assert [(r.p, r.f, r.got) for r in got] == cases


def test_the_last_record_of_a_path_tells_a_tape(spark):
    known = entries(spark, [("old", "a", 5, A, None, 1), ("old", "a", 5, B, None, 2), ("right", "a", 5, B, None, 1), ("right", "a", 5, A, None, 2)])
    mounted = entries(spark, [("x", "a", 5, A, None, 1)])
    assert [r.tape_id for r in catalog.matching_tapes(mounted, known).collect()] == ["right"]


def test_a_full_tape_stops_the_run(spark):
    planned = put.decide(files_of(spark, [(n, 5, 1, n * 64) for n in "abcd"]), entries(spark, []), entries(spark, []), entries(spark, []), tape_rows(spark, []), "t")
    got = {r.rel: r.decision for r in put.until_full(planned, F.col("size"), 12).collect()}
    assert got == {"a": "ARCHIVE", "b": "ARCHIVE", "c": "FULL", "d": "STOPPED"}


def test_purge_reasons(spark):
    e = entries(spark, [("t1", "a", 5, A, None, 1), ("t1", "b", 5, B, None, 1), ("t2", "r", 5, A, ("t1", "a"), 1)]).withColumn("source", F.concat(F.lit("/src/"), "path"))
    t = tape_rows(spark, [("t1", "ONE", None), ("t2", "TWO", None)])
    files = spark.createDataFrame([("/src/a", 5, 1), ("/src/b", 5, 2), ("/src/new", 5, 1), ("/src/r", 5, 1)], "path string, size long, mtime_ns long")
    never = spark.createDataFrame([], schemas.VERIFICATIONS)
    got = {r.path: r.reason for r in purge.plan(files, e, e, t, never).collect()}
    assert got["/src/new"] == "not archived" and got["/src/b"] == "archived copy differs"
    assert got["/src/a"] == got["/src/r"] == "tape ONE has not passed verification since archiving"
    ok = spark.createDataFrame([("t1", 1, 11, 3, 3, 0, 0, 0)], schemas.VERIFICATIONS)
    planned = purge.plan(files, e, e, t, ok)
    assert {r.path for r in planned.where("decision = 'DELETE'").collect()} == {"/src/a", "/src/r"}
    assert tuple(purge.totals(planned).first())[:3] == (2, 2, 10)
    assert {r.path: r.reason for r in purge.plan(files, e, e, t, ok, copies=2).collect()}["/src/a"] == "only 1 of 2 required verified copies (ONE)"
    assert purge.recheck(planned, files.where("path <> '/src/a'")).count() == 1


def test_recover_and_flush(spark):
    e = entries(spark, [("t", "known", 5, A, None, 1)])
    listing = spark.createDataFrame([("known", True, 5, None), ("new", True, 3, 9), ("first", True, 3, 2), (".archive/volume.json", True, 1, None), ("half.partial", True, 1, None), ("link", False, 1, None), ("SHA256SUMS", True, 1, None)], "path string, regular boolean, size long, block long")
    got = [(r.path, r.decision) for r in tape.recover(listing, e).collect()]
    assert got[:2] == [("first", "ORPHAN"), ("new", "ORPHAN")] and {p for p, d in got if d == "IGNORED"} == {"half.partial", "link"}
    pending = spark.createDataFrame([("known", 5, A, None, None), ("new", 3, B, None, None), ("gone", 3, B, None, None)], f"path string, size long, sha256 string, ref {schemas.REF}, age {schemas.AGE}")
    assert {r.path: r.decision for r in tape.flush(pending, e, listing).collect()} == {"known": "RECORDED", "new": "NEW", "gone": "ROLLED_BACK"}


def test_restore_names_other_tapes(spark, two):
    e, _ = two
    status = spark.createDataFrame([("t1", "iso/Ubuntu.iso", "failed"), ("t1", "x", "OK"), ("t2", "ref", "OK")], "tape_id string, path string, status string")
    got = {r.path: (r.decision, r.other_tapes) for r in tape.restore(e, status).collect()}
    assert got == {"iso/Ubuntu.iso": ("FAILED", ["t2"]), "x": ("RESTORE", None), "ref": ("REF", ["t1"])}


def test_encryption_gate(spark):
    t = spark.createDataFrame([("a", "", None, 0, 3, 0, 0, None, ("LTO", ["k"], 1)), ("b", "", None, 0, 3, 0, 0, None, None)], schemas.TAPES)
    drives = spark.createDataFrame([("a", False, None), ("b", True, "k")], "id string, encrypting boolean, key string")
    assert {r.id: r.decision for r in tape.encryption_gate(t, drives).collect()} == {"a": "REFUSE", "b": "NOTE"}
