import random

from pyspark.sql import functions as F

from archivolt.operators import ordered


def test_segments_flush_after_the_row_that_fills(spark):
    df = spark.createDataFrame([("t", 1, 5), ("t", 2, 0), ("t", 3, 5)], "tape_id string, line_no long, size long")
    got = {r.line_no: r.segment for r in ordered.flush_segments(df, ["tape_id"], "line_no", "size", 1).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_damage_range_ends_at_the_file(spark):
    df = spark.createDataFrame([("a", 2), ("b", 0), ("b", 1), ("b", 3), ("b", 62)], "path string, i int")
    got = dict(map(tuple, ordered.bad_ranges(df, ["path"], "i", F.lit(16), F.lit(1000)).collect()))
    assert got == {"a": "32-47", "b": "0-31, 48-63, 992-999"}


def test_counters_that_fall_or_are_missing_say_nothing(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, None), (4, 1)], "t int, n int").withColumn("d", F.lit("d"))
    got = [r.n_since for r in ordered.since_baseline(df, ["d"], [F.col("t")], ["n"]).orderBy("t").collect()]
    assert got == [0, 3, None, 1]
    df = df.where("t > 1")
    assert [r.n_since for r in ordered.since_baseline(df, ["d"], [F.col("t")], ["n"]).orderBy("t").collect()] == [0, None, None]


def test_links(spark):
    polls = [("d", 1, "p0", "6"), ("d", 1, "p1", "6"), ("d", 2, "p0", "3"), ("d", 2, "p2", "6"), ("d", 3, "p0", "3"), ("d", 3, "p1", "6"), ("d", 4, None, None)]
    got = ordered.link_changes(spark.createDataFrame(polls, "drive string, ts int, link string, rate string")).orderBy("ts", "link").collect()
    assert [tuple(r) for r in got] == [("d", 2, "p0", "6", "3"), ("d", 2, "p1", "6", None), ("d", 4, "p0", "3", None)]


def test_greedy_accept_matches_a_loop(spark):
    r = random.Random(1)
    rows = [(f, i, r.choice("AB"), r.choice("xyz"), r.random() < 0.6) for f in range(60) for i in range(r.randrange(1, 8))]
    df = spark.createDataFrame(rows, "f int, i int, sha string, tape string, ok boolean")
    got = ordered.accepted_copies(df, ["f"], [F.col("i")], F.col("ok"), "sha", "tape", F.lit(2)).collect()
    want = set()
    for f in range(60):
        sha, seen = None, []
        for _, i, s, t, ok in sorted(x for x in rows if x[0] == f):
            if ok and (sha is None or s == sha) and t not in seen and len(seen) < 2:
                sha, seen = s, [*seen, t]
                want.add((f, i))
    assert {(x.f, x.i) for x in got} == want


def test_prefixes_and_tails(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("c", 1, False)], "f string, n int, bad boolean")
    assert sorted((r.f, r.n) for r in ordered.valid_prefix(df, ["f"], [F.col("n")], F.col("bad")).collect()) == [("a", 1), ("b", 1), ("c", 1)]
    tails = {r.f: (r.torn, r.damaged_at) for r in ordered.torn_tail(df, ["f"], "n", F.col("bad")).collect()}
    assert tails == {"a": (False, 2), "b": (True, None), "c": (False, None)}


def test_running_lists(spark):
    df = spark.createDataFrame([("j", 1, ["a"]), ("j", 2, []), ("j", 3, ["b", "c"])], "f string, n int, chunks array<string>")
    got = [r.chunks for r in ordered.running_lists(df, ["f"], [F.col("n")], ["chunks"]).orderBy("n").collect()]
    assert got == [["a"], ["a"], ["a", "b", "c"]]


def test_what_does_not_fit_ends_the_run(spark):
    df = spark.createDataFrame([("t", 1, 5), ("t", 2, 9), ("t", 3, 1)], "t string, n int, need int")
    assert [r.n for r in ordered.prefix_that_fits(df, ["t"], [F.col("n")], F.col("need"), F.lit(10)).collect()] == [1]


def test_orders(spark):
    df = spark.createDataFrame([("b", None), ("a/z", None), ("a-b", 7), ("c", 3)], "path string, block int")
    assert [r.path for r in df.orderBy(*ordered.tape_order()).collect()] == ["c", "a-b", "a/z", "b"]
    assert [r.path for r in df.orderBy(ordered.walk_order()).collect()][:2] == ["a/z", "a-b"]


def test_segments_of_rows_with_one_order(spark):
    rows = [("t", 1, 4), ("t", 1, 4), ("t", 2, 4), ("u", 1, 50), ("u", 2, None), ("u", 3, 9), ("u", 4, 2), ("u", 5, 1)]
    got = ordered.flush_segments(spark.createDataFrame(rows, "tape_id string, line_no long, size long").repartition(3), ["tape_id"], "line_no", "size", 10).collect()
    assert sorted((r.tape_id, r.line_no, r.segment) for r in got) == [("t", 1, 1), ("t", 1, 1), ("t", 2, 1), ("u", 1, 1), ("u", 2, 2), ("u", 3, 2), ("u", 4, 2), ("u", 5, 3)]


def test_places_over_ranges(spark):
    paths = [f"{a}/{i}" for a in ("a", "a-b", "a/c", "b") for i in range(40)]
    got = ordered.numbered(spark.createDataFrame([(p,) for p in paths], "path string").repartition(5), [ordered.walk_order("path")]).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.place)] == sorted(paths, key=lambda p: p.split("/")) and sorted(r.place for r in got) == list(range(1, 161))
