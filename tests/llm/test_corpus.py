"""Operators across rows against brute force: near-duplicates, components, embeddings, mixing, the pipeline."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from archivolt.llm import mixing, pivot_index, probminhash
from archivolt.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)] + [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_chain_of_rising_numbers_takes_few_rounds(spark, monkeypatch):
    from archivolt.llm import components

    rounds, contracted = [], components.contracted
    monkeypatch.setattr(components, "contracted", lambda edges, step: rounds.append(step) or contracted(edges, step))
    chain = spark.range(1000).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.range(400).selectExpr("5000L AS a", "5200 + id AS b"))
    got = {x.node: x.component for x in connected_components(chain).collect()}
    assert len(rounds) <= 16 and all(got[i] == 0 for i in range(1001)) and all(got[5200 + i] == 5000 for i in range(400))


# near-duplicates


def shingle_weights(text):
    words = text.encode().split()
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return {s: 1 + math.log(runs.count(s)) for s in set(runs)}


def slow_jaccard(a, b):
    out = 0.0
    for d in a.keys() & b.keys():
        out += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 12), st.floats(1, 4), min_size=1), st.dictionaries(st.integers(0, 12), st.floats(1, 4), min_size=1))
def test_probability_jaccard(a, b):
    arrays = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
    assert abs(probminhash.probability_jaccard(*arrays(a), *arrays(b)) - slow_jaccard(a, b)) < 1e-9


def test_sketches_estimate_it():
    r = np.random.default_rng(2)
    keys = r.integers(0, 2**63, 60).astype(np.uint64)
    a, b = np.sort(keys[:50]), np.sort(keys[8:])
    wa, wb = 1 + np.log(r.integers(1, 6, 50)), 1 + np.log(r.integers(1, 6, 52))
    size = 4000
    sk = probminhash.sketches(np.repeat([0, 1], [50, 52]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, size)
    want = probminhash.probability_jaccard(a, wa, b, wb)
    assert abs((sk[0] == sk[1]).mean() - want) < 5 * math.sqrt(want * (1 - want) / size)


def varied(r, n=120):
    return [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(n)]


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies, chains, repeated lines, a passage that many share, exact copies, odd rows."""
    r = random.Random(7)
    texts = []
    for _ in range(6):
        base = varied(r)
        for _ in range(8):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = "changed" + str(r.randrange(1000))
            texts.append(" ".join(t))
    chain = varied(r)
    for i in range(12):
        chain = list(chain)
        chain[i * 9] = f"step{i}"
        texts.append(" ".join(chain))
    passage = varied(r, 60)
    texts += [" ".join([*varied(r, 60), *passage]) for _ in range(40)]
    line = " ".join(varied(r, 12))
    texts += ["\n".join([line] * n + [" ".join(varied(r, 8))]) for n in (2, 3, 30)]
    texts += [" ".join(varied(r)) for _ in range(40)] + ["short text", "short text", "", " \n", "one"]
    rows = [(i, t, "s", 0) for i, t in enumerate(texts)] + [(900, None, None, 0), (901, texts[0], "x", 0), (901, texts[0], "x", 0), (902, texts[60], "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, node long"), rows


def slow_classes(rows):
    weights = {i: shingle_weights(t or "") for i, t, *_ in rows}
    links = [(a, b) for (a, ta, *_), (b, tb, *_) in combinations(rows, 2) if (ta or "") == (tb or "") or slow_links(weights[a], weights[b])]
    return roots(weights, links)


def slow_links(a, b):
    if not a or not b or len(a.keys() & b.keys()) < 0.5 * min(len(a), len(b)):
        return False
    return slow_jaccard(a, b) >= 0.8


def test_near_duplicates_match_brute_force(copies):
    df, rows = copies
    got = probminhash.near_duplicates(df).collect()
    want = slow_classes(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id) for r in got} == set(want.items())
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_crowded_buckets_lose_nothing(copies):
    df, rows = copies
    tight = probminhash.Sketch(small=3)
    assert {(r.doc_id, r.class_id) for r in probminhash.near_duplicates(df.repartition(3), tight).collect()} == set(slow_classes(rows).items())


@pytest.fixture(scope="module")
def edited(spark):
    """A text with a doc_id in the middle and 1,000 edited copies: each is a near copy of it, hardly any of each other."""
    r = random.Random(5)
    base = varied(r, 500)
    rows = []
    for i in range(1001):
        t = list(base)
        for at in r.sample(range(500), 9) if i != 500 else ():
            t[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(t)))
    return rows


def test_an_original_in_the_middle_holds_its_copies_together(spark, edited):
    weights = {i: shingle_weights(t) for i, t in edited}
    assert all(w == 1 for x in weights.values() for w in x.values())  # so that it is the Jaccard index of sets
    alike = lambda a, b: len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    links = [(500, i) for i in weights if i != 500 and alike(weights[500], weights[i]) >= 0.8]
    assert len(links) > 900 and np.mean([alike(weights[i], weights[i + 1]) for i in range(400)]) < 0.75
    df = spark.createDataFrame(edited, "doc_id long, text string").repartition(4)
    for p in (probminhash.Sketch(), probminhash.Sketch(small=3, block=100)):
        got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(df, p).collect()}
        assert len(got) == 1001 and all(got[i] == got[500] for _, i in links)


def test_texts_that_share_a_doc_id_are_all_compared(spark):
    r = random.Random(3)
    a, b, c = varied(r), varied(r), varied(r)
    near = lambda t, k: " ".join([*t[:60], f"edit{k}", *t[61:]])
    plain = [" ".join(x) for x in (a, b, c)]
    rows = [(7, plain[0]), (7, plain[1]), (8, near(a, 8)), (9, near(b, 9)), (3, plain[2]), (12, near(c, 12)), (7, plain[0]), (20, " ".join(varied(r))), (20, near(c, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.class_id) for x in probminhash.near_duplicates(df).collect()}
    assert got == {(7, 7), (8, 7), (9, 7), (3, 3), (12, 3), (20, 3)}
    assert sorted(x.doc_id for x in probminhash.one_of_each(df).collect()) == [3, 7, 7]


def test_a_very_long_text(spark):
    r = random.Random(4)
    long = varied(r, 150_000)
    rows = [(1, " ".join(long)), (2, " ".join([*long[:70_000], "changed", *long[70_001:]])), (3, " ".join(varied(r, 150_000))), (4, "x" * 3_000_000)]
    got = {x.doc_id: x.class_id for x in probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_boilerplate_that_thousands_share(spark):
    """5,000 texts that share a passage, not enough to link them, and ten near copies among them: crowded buckets, recall measured."""
    r = random.Random(6)
    passage = varied(r, 100)
    texts = [[*passage, *varied(r, 45)] for _ in range(5000)]
    for k in range(10):
        texts[400 * k + 300] = [*texts[400 * k + 7][:120], f"edit{k}", *texts[400 * k + 7][121:]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.class_id for x in probminhash.near_duplicates(df, probminhash.Sketch(rows=2, bands=20)).collect()}
    linked = {i: c for i, c in got.items() if i != c}
    assert linked == {400 * k + 300: 400 * k + 7 for k in range(10)}


def test_links_are_named_as_those_compared(copies):
    df, _ = copies
    assert probminhash.near_duplicates(df.limit(0)).columns == ["doc_id", "class_id", "text_class", "compared_links", "kept"]


def test_one_of_each_stays(copies, spark):
    df, rows = copies
    want = {i for i, c in slow_classes(rows).items() if i == c}
    kept = probminhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert probminhash.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "z")], "doc_id long, text string")
    assert probminhash.near_duplicates(nulls).count() == 3


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == set(slow_classes(rows).items())


# embeddings


@pytest.mark.parametrize("size", [64, 3])
def test_vectors_match_brute_force(spark, size):
    r = np.random.default_rng(size)
    base = r.standard_normal((150, size))
    near = base[r.integers(0, 40, 120)] + 0.06 * r.standard_normal((120, size)) * np.sqrt(3 / size)
    hot = base[0] + 0.02 * r.standard_normal((90, size))
    v = np.concatenate([base, near, hot, base[:5], 2 * base[5:8]]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(2000, None, 0), (2001, [0.0] * size, 0), (2002, [float("nan")] * size, 0), (2003, [float("inf")] * size, 0), (2004, [None] + [1.0] * (size - 1), 0), (2005, [], 0), (2006, [1.0] * (size + 1), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in pivot_index.near_vectors(df, pivot_index.PivotIndex(block=40)).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    assert all(got[i][0] <= d for i, d in enumerate(s.sum(1)))
    assert sum(got[i][0] for i in range(len(v))) >= 0.97 * s.sum()
    want = roots(range(len(v)), np.argwhere(np.triu(s)).tolist())
    assert np.mean([got[i][1] == c for i, c in want.items()]) > 0.97
    assert all(got[i] == (0, i, True) for i in range(2000, 2007)) and len(got) == len(rows) + len(odd)


def test_vectors_that_share_an_id_are_vectors_of_their_own(spark):
    r = np.random.default_rng(1)
    a, b = r.standard_normal((2, 64))
    rows = [(5, a.tolist()), (5, b.tolist()), (6, (a + 0.01).tolist()), (8, (b + 0.01).tolist()), (9, b.tolist()), (9, b.tolist()), (None, a.tolist())]
    got = sorted((x.vec_id or 0, x.n_links, x.component_id) for x in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    none = got[0][0]
    assert none < 0 and got == sorted([(none, 2, none), (5, 2, none), (5, 2, 5), (6, 2, none), (8, 2, 5), (9, 2, 5), (9, 2, 5)])


def test_clashing_columns_of_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, v.tolist(), 1, 2, 3) for i, v in enumerate(r.standard_normal((30, 8)))]
    got = pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, node long, key long"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == 30


def test_hot_lists_are_inverted_once_more():
    """Rows of a hot list grow with its vectors, not with their square, and every pair that shares four pivots meets once."""
    p, r = pivot_index.PivotIndex(), np.random.default_rng(3)
    for n in (1000, 4000, 16000):
        lists = np.sort(np.array([[0, 1, *r.choice(np.arange(2, 256), 6, replace=False)] for _ in range(n)]), axis=1)
        row, key = pivot_index.refined(np.full(n, 0 * 256 + 1), lists, p)
        assert len(row) <= 15 * n and len(np.unique(key)) > 1000
    lists = np.sort(np.array([r.choice(14, 8, replace=False) for _ in range(60)]), axis=1)
    met = {}
    for i, j in combinations(range(14), 2):
        held = np.flatnonzero((lists[:, :6] == i).any(axis=1) & (lists[:, :6] == j).any(axis=1))
        row, key = pivot_index.refined(np.full(len(held), i * 256 + j), lists[held], p)
        for k in np.unique(key):
            own = held[row[key == k]]
            vectors = np.ones((len(own), 3))
            found = pivot_index.compare(int(k), 0, 0, own, np.ones(len(own), int), np.zeros(len(own), int), lists[own], vectors, p)
            for node, links in zip(*found[:2]) if found else ():
                met[node] = met.get(node, 0) + links
    share = [[len(np.intersect1d(a, b)) >= 4 for b in lists] for a in lists]
    assert all(met.get(i, 0) == sum(x) - 1 for i, x in enumerate(share))


def test_no_vectors(spark):
    assert pivot_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# mixing


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, "x" * (4 * (1 + i % 9)), "big") for i in range(3000)] + [(10_000 + i, "y" * 40, f"small{i % 7}") for i in range(700)] + [(20_000, None, None), (20_001, "", None), (20_002, "dup", "big"), (20_002, "dup", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit("own"))


def test_the_exponent_meets_its_target(spark, sources):
    table = sources.groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("tokens")).where("source is not null")
    t = np.array([r.tokens for r in table.collect()], float)
    entropy = lambda a: -sum(p * math.log(p) for p in t**a / (t**a).sum())
    a = mixing.exponent(table, mixing.Mix(entropy=0.9, max_repeats=1e9))
    assert abs(entropy(a) - 0.9 * math.log(len(t))) < 1e-3
    b = mixing.exponent(table, mixing.Mix(entropy=None, max_repeats=2.0))
    assert abs((t.max() / t.min()) ** (1 - b) - 2.0) < 1e-6
    assert mixing.exponent(table.limit(1), mixing.Mix()) == 1.0 and mixing.exponent(table.limit(0), mixing.Mix()) == 1.0


def slow_quotas(tokens, entropy=0.95, most=2.0):
    """Tokens of each source in the mixture, by plain bisection in numpy."""
    t = np.array(list(tokens.values()), float)

    def spread(a):
        w = t**a / (t**a).sum()
        return -(w * np.log(w)).sum()

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if spread(middle) >= entropy * math.log(len(t)) else (low, middle)
    a = max(low, 1 - math.log(most) / math.log(t.max() / t.min()))
    w = t**a / (t**a).sum()
    budget = (t / w).max()
    return dict(zip(tokens, np.minimum(w * budget, most * t)))


def test_mixtures(spark, sources):
    mix = mixing.Mix(block_tokens=500)
    got = mixing.mix_sources(sources, mix).select("row.doc_id", "source", "tokens", "pass", "block").toPandas()
    total = {}
    for r in sources.collect():
        total[r.source or "\x00"] = total.get(r.source or "\x00", 0) + max(1, -(-len((r.text or "").encode()) // 4))
    for source, quota in slow_quotas(total).items():
        g = got[got.source == source]
        assert quota * 0.9999 - 10 - 1 <= g.tokens.sum() <= quota * 1.0001 + 1
        whole = int(round(quota)) // total[source]
        for k, one in g.groupby("pass"):
            assert one.tokens.sum() == total[source] if k < whole else one.tokens.sum() <= total[source]
        if whole in set(g["pass"]):  # the part of a pass is whole blocks and a part of one
            draws = g[g["pass"] == whole].groupby("block").tokens.sum()
            again = mixing.mix_sources(sources, mixing.Mix(block_tokens=500, budget=10**9, max_repeats=float(whole + 1))).where(F.col("source") == source).where(F.col("pass") == whole)
            full = {r.block: r.t for r in again.groupBy("block").agg(F.sum("tokens").alias("t")).collect()}
            assert sum(draws[b] < full[b] for b in draws.index) <= 1
    assert set(got[got["pass"] == 0].doc_id) == {r.doc_id for r in sources.collect()}  # nothing is dropped
    again = mixing.mix_sources(sources.repartition(11), mix).select("row.doc_id", "source", "tokens", "pass", "block").toPandas()
    key = ["doc_id", "pass", "block"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    out = mixing.mixed_documents(sources, mix)
    assert out.columns == sources.columns and out.count() == len(got)
    assert mixing.mix_sources(sources.limit(0), mix).count() == 0


def test_a_small_budget_takes_parts(spark, sources):
    got = mixing.mix_sources(sources, mixing.Mix(budget=2000, block_tokens=300)).toPandas()
    assert 1800 < got.tokens.sum() <= 2000 and got["pass"].max() == 0


# the pipeline


def test_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, before, SF), "stage")
        if name == "quality rules":
            ids = {r.doc_id for r in after.collect()}
            for r in before.collect():
                assert r.doc_id in ids or len(r.text.split()) < 60 or len(set(r.text.split())) < len(r.text.split())
        if name == "near-dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in after.collect()} == {i for i, c in slow_classes(rows).items() if i == c}
        if name == "secret scans":
            assert after.count() == before.count() and not after.where("text rlike 'AKIA[A-Z0-9]{12}'").count()
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} and after.count() >= before.count()
        if name != "sentencepiece":
            assert after.columns == names
            before = after
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} and after.where("size(ids) <> n_pieces").isEmpty()
    run = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.ids_crc32) for r in after.collect())


def test_the_pipeline_takes_odd_rows(spark, tmp_path):
    good = lambda i: " ".join(f"word{i}x{j}" for j in range(80))
    rows = [(i, good(i), "en", f"s{i % 3}", 0) for i in range(30)] + [(30, good(3), "en", "s0", 0), (31, None, None, None, None), (None, good(77), "de", None, 1), (32, "", "fr", "s1", 0), (5, good(5), "en", "s2", 0), (33, good(40) + " password=abcdefgh12", "en", "s1", 3)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, key long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids >= {*range(30), 33} and None in ids and not ids & {30, 31, 32}
    empty = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
