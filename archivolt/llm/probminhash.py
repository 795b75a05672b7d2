"""Near-duplicate groups by ProbMinHash sketches of weighted word shingles, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import GOLDEN, Words, discard, distinct_counts, mix64, shingles, slices, small_side, text_key, texts_of, uniform, written
from archivolt.llm.components import connected_components
from archivolt.llm.pivot_index import local_roots


@dataclass(frozen=True)
class Sketch:
    """width: words in a shingle; bands x rows: sketch components; threshold: least similarity of a link.

    At a similarity of 0.8, 40 bands of 6 rows miss a pair with probability (1 - 0.8^6)^40 = 5e-6.
    small: members of a bucket whose pairs are listed. Larger buckets that hold several components are compared whole,
    in blocks of `block` members.
    """

    width: int = 5
    bands: int = 40
    rows: int = 6
    threshold: float = 0.8
    small: int = 24
    block: int = 512

    @property
    def size(self) -> int:
        return self.bands * self.rows


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle's weight: 1 + ln(times it occurs), so a repeated passage counts more but doesn't drown the rest."""
    return 1.0 + np.log(counts)


def sketches(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """(n, size) components: for each the shingle whose Poisson process (rate: its weight) arrives there first.

    Two texts agree in a component with the probability Jaccard of their weighted shingles. Arrivals are
    drawn in order of time up to a horizon at which about a third of texts still lack a component; only those
    go on to a later horizon. No later arrival can change a full sketch, so stopping there is exact.
    """
    best, least = np.zeros(n * size, np.uint64), np.full(n * size, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n)
    horizon = np.where(total > 0, size * (math.log(size) + 1) / np.maximum(total, 1e-300), 0.0)
    state = mix64(key + GOLDEN)
    time = -np.log(uniform(state)) / weight
    live = np.flatnonzero(time <= horizon[doc])
    open_docs = total > 0
    while True:
        while len(live):
            draw = mix64(state[live] ^ GOLDEN)
            at = doc[live] * size + (draw % np.uint64(size)).astype(np.int64)
            when = time[live]
            np.minimum.at(least, at, when)
            won = least[at] == when
            best[at[won]] = key[live[won]]
            state[live] = mix64(state[live] + GOLDEN)
            time[live] += -np.log(uniform(state[live])) / weight[live]
            live = live[time[live] <= horizon[doc[live]]]
        open_docs &= np.isinf(least.reshape(n, size)).any(axis=1)
        if not open_docs.any():
            return best.reshape(n, size)
        horizon[open_docs] *= 1.4
        live = np.flatnonzero(open_docs[doc] & (time <= horizon[doc]))


def band_keys(components: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(components), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(components), b + 1, np.uint64)
        for j in range(rows):
            h = mix64(h * GOLDEN + components[:, b * rows + j])
        out[:, b] = h
    return out.view(np.int64)


def probability_jaccard(ka, wa, kb, wb) -> float:
    """sum over common d of 1 / sum over d' of max(a_d'/a_d, b_d'/b_d), exactly, from sorted keys and weights."""
    if not len(ka) or not len(kb):
        return 0.0
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    union = len(ka) + len(kb) - len(common)
    if wa is None and wb is None:
        return len(common) / union
    wa = np.ones(len(ka)) if wa is None else wa
    wb = np.ones(len(kb)) if wb is None else wb
    a, b = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    ratio = a / b
    first = np.searchsorted(ratio, ratio, side="left")
    up = np.concatenate([np.cumsum(a[::-1])[::-1], [0.0]])[first] + only_a  # ratio at least d's, or not in b
    down = np.concatenate([[0.0], np.cumsum(b)])[first] + only_b
    return float((1.0 / (up / a + down / b)).sum())


def _sketched(p: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(texts_of(part))
                doc, key, times = distinct_counts(*shingles(words.hashes(), words.counts, p.width))
                n = part.num_rows
                has = np.bincount(doc, minlength=n) > 0
                parts = sketches(doc, key, weights(times), n, p.size)
                ends = np.concatenate([[0], np.cumsum(np.where(has, p.bands, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(parts, p.bands, p.rows)[has].ravel()))
                short = pa.array([x.tobytes() for x in parts.astype(np.uint8)], pa.binary())  # equal components stay equal
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("tkey"), bands, short], ["doc", "tkey", "bands", "sketch"])

    return run


def _shingled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(texts_of(part))
                doc, key, times = distinct_counts(*shingles(words.hashes(), words.counts, width))
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                keys = [key[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                many = [times[a:b].astype(np.uint32).tobytes() if (times[a:b] > 1).any() else b"" for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(keys, pa.binary()), pa.array(many, pa.binary())], ["node", "keys", "times"])

    return run


def _weighed(times: bytes):
    return weights(np.frombuffer(times, np.uint32).astype(np.float64)) if times else None


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sim = [], [], []
            for i in range(batch.num_rows):
                ka, ta, kb, tb = (batch.column(c)[i].as_py() for c in ("a_keys", "a_times", "b_keys", "b_times"))
                s = probability_jaccard(np.frombuffer(ka, np.uint64), _weighed(ta), np.frombuffer(kb, np.uint64), _weighed(tb))
                if s >= threshold:
                    a.append(batch.column("a")[i].as_py())
                    b.append(batch.column("b")[i].as_py())
                    sim.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, p: Sketch) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("keys").alias(f"{side}_keys"), F.col("times").alias(f"{side}_times")), side)
    return pairs.select("a", "b", "a_keys", "a_times", "b_keys", "b_times").mapInArrow(_verified(p.threshold), "a long, b long, similarity double")


def _mixed(rows: DataFrame, tag: str) -> DataFrame:
    """rows (key, node, component) of the buckets with more than two members and several components, with n and rep (the least node)."""
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("rep"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    stats = stats.where("lo < hi and n > 2").select("key", "n", "rep")
    return written(rows.join(stats, "key"), tag)


def _listed(rows: DataFrame) -> DataFrame:
    """The pairs of each bucket across components; of small buckets only."""
    a = rows.select("key", F.col("node").alias("a"), F.col("component").alias("ca"))
    b = rows.select("key", F.col("node").alias("b"), F.col("component").alias("cb"))
    return a.join(b, "key").where("a < b and ca <> cb").select("a", "b")


def least_agreement(size: int, similarity: float, miss: float = 1e-6) -> int:
    """Equal components of two texts of that similarity: fewer with probability `miss` at most."""
    below = 0.0
    for k in range(size):
        below += math.comb(size, k) * similarity**k * (1 - similarity) ** (size - k)
        if below > miss:
            return k
    return size


def close_pairs(sketch: np.ndarray, part: np.ndarray, component: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, equal components) of the pairs of a group across its two parts, or within its only one, that have `least` equal
    components or more and lie in different components of the graph."""
    left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    columns, found = np.ascontiguousarray(sketch.T), []
    across = columns[:, right]
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        equal = np.zeros((len(rows), len(right)), np.uint16)
        for mine, others in zip(columns[:, rows], across):
            equal += mine[:, None] == others[None, :]
        ok = (equal >= least) & (component[rows][:, None] != component[right][None, :])
        if part.min() == part.max():
            ok &= rows[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        found.append((rows[x], right[y], equal[x, y]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _whole_groups(compare, names: list[str]):
    """Hands compare() the rows of one (key, i, j) at a time; they come one after the other. It gives columns, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group so far; a group has two blocks of rows at most

        def out(groups):
            done = [x for x in (compare(g) for g in groups if g.num_rows > 1) if x is not None]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done)], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            group = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], cut])
            yield from out(table.slice(a, b - a) for a, b in zip(starts, cut))
            held = table.slice(int(starts[-1])).combine_chunks()
        if held is not None:
            yield from out([held])

    return run


def _close_in(rows: pa.Table, least: int):
    node, part, component = (rows.column(c).to_numpy() for c in ("node", "part", "component"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
    return node, close_pairs(sketch, part, component, least)


def _close(p: Sketch):
    """For each member of a group with a close one the least member it is close to, over any number of steps."""
    least = least_agreement(p.size, p.threshold)

    def compare(rows: pa.Table):
        node, (a, b, _) = _close_in(rows, least)
        if not len(a):
            return None
        root = local_roots(len(node), a, b)
        some = np.flatnonzero(root != np.arange(len(node)))
        return node[root[some]], node[some]

    return _whole_groups(compare, ["a", "b"])


def _linked(p: Sketch):
    """Links that join a group's components: all close pairs are verified, the closest first, but those joined by then."""
    least = least_agreement(p.size, p.threshold)

    def compare(rows: pa.Table):
        node, (a, b, equal) = _close_in(rows, least)
        up = {int(c): int(c) for c in rows.column("component").to_numpy()}
        of = rows.column("component").to_pylist()
        keys, times = rows.column("keys").to_pylist(), rows.column("times").to_pylist()

        def root(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        found = []
        for k in np.argsort(-equal.astype(np.int64), kind="stable").tolist():
            x, y = sorted((int(a[k]), int(b[k])), key=lambda i: node[i])
            cx, cy = root(of[x]), root(of[y])
            if cx == cy:
                continue
            s = probability_jaccard(np.frombuffer(keys[x], np.uint64), _weighed(times[x]), np.frombuffer(keys[y], np.uint64), _weighed(times[y]))
            if s >= p.threshold:
                up[cx] = cy
                found.append((node[x], node[y], s))
        return tuple(np.array(c) for c in zip(*found)) if found else None

    return _whole_groups(compare, ["a", "b", "similarity"])


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows (key, n: rows of the key, node, ...) in groups (key, i, j) of two blocks at most: each pair of a key's blocks is a group."""
    rows = rows.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def _crowded(rows: DataFrame, bands: DataFrame, sets: DataFrame, p: Sketch) -> DataFrame:
    """Links that join the components of crowded buckets: rows (key, node, component, n).

    All pairs of a bucket across components are looked at, first by their sketches: pairs with too few equal components
    for p.threshold go (1e-6 of those at it). What is left joins the texts into families; all close pairs of a family
    are verified, each family once, however many buckets it shares. Work grows with the square of a bucket, rows with
    that over p.block.
    """
    groups = _blocks(rows.select("key", "node", "component", "n").join(bands.select("node", "sketch"), "node"), p.block)
    close = written(groups.mapInArrow(_close(p), "a long, b long").distinct(), "close")
    families = connected_components(close).select("node", F.col("component").alias("key"))
    families = families.join(rows.select("node", "component").distinct(), "node")
    families = written(families.join(families.groupBy("key").agg(F.count("*").alias("n")), "key"), "families")
    members = small_side(families).join(bands.select("node", "sketch"), "node").join(sets, "node")
    return _blocks(members, p.block).mapInArrow(_linked(p), "a long, b long, similarity double")


def _rest(rows: DataFrame, stars: DataFrame, bands: DataFrame, sets: DataFrame, p: Sketch) -> DataFrame:
    """Links between texts of one bucket that are still in different components; rows: of _mixed().

    Buckets of p.small members at most are listed, larger ones compared in blocks. A pair is left out only where it has
    been compared as a bucket's least node and a member, or where its texts are joined already.
    """
    small = _listed(rows.where((F.col("n") <= p.small) & (F.col("node") != F.col("rep"))))
    links = _verify(written(small.distinct().join(stars, ["a", "b"], "left_anti"), "rest"), sets, p)
    crowded = rows.where(F.col("n") > p.small)
    if not crowded.isEmpty():
        links = links.unionByName(_crowded(crowded, bands, sets, p))
    return written(links.dropDuplicates(["a", "b"]), "links")


def _node(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseOR(F.lit(-(1 << 63))))


def _texts(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tkey, text_class, node) of each distinct text; links a, b between the texts of documents that have several).

    text_class: the least doc_id with the text. node: the same number, but where several texts have one least doc_id (rows
    that share it) all but one get a hash of theirs, so that every text is a node of its own.
    """
    least = sketched.groupBy("tkey").agg(F.min("doc").alias("text_class"))
    first = least.groupBy("text_class").agg(F.min("tkey").alias("first"))
    node = F.when(F.col("tkey") == F.col("first"), F.col("text_class")).otherwise(F.xxhash64("tkey", "text_class"))
    texts = written(least.join(first, "text_class").select("tkey", "text_class", node.alias("node")), "texts")
    several = sketched.groupBy("doc").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi")).where("lo < hi").select("doc")
    nodes = sketched.select("doc", "tkey").join(several, "doc", "left_semi").distinct().join(texts, "tkey").select("doc", "node")
    low = nodes.groupBy("doc").agg(F.min("node").alias("a"))
    return texts, written(nodes.join(low, "doc").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "same_doc")


def near_duplicates(docs: DataFrame, p: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, text_class, compared_links, kept.

    class_id: the least doc_id among texts joined by links; a link is a probability Jaccard of at least
    p.threshold between the weighted p.width-word shingles of two different texts. text_class: the least
    doc_id with the same text. compared_links: links found between the text and others among the pairs that
    were compared; pairs of one class that other links join already are not. kept: doc_id = class_id.

    Equal texts are one class whatever they hold, empty and null ones (null = empty) included; texts without a
    word link with no other text. A text of fewer than p.width words is one shingle; very long texts are taken whole, a
    slice of their own. Rows without a doc_id stand under a negative number made from their text. Rows that share a doc_id are
    one document: each of their texts is banded and compared, the texts' classes are one, and kept is true for each of
    the rows, or none. Repeated rows get the same result each. Other columns are ignored. An empty table gives no rows.

    No pair of equal texts is made. In each bucket only the least member is compared with the others first;
    all pairs that could still join two components follow, see _rest().
    """
    rows = docs.select(_node(id_col, text_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tkey", text_key())
    sketched = written(rows.mapInArrow(_sketched(p), "doc long, tkey binary, bands array<long>, sketch binary"), "sketched")
    texts, same_doc = _texts(sketched)
    head = texts.withColumnRenamed("text_class", "doc")
    bands = written(sketched.where(F.size("bands") > 0).join(head, ["tkey", "doc"]).dropDuplicates(["tkey"]).select("node", "tkey", "doc", "bands", "sketch"), "bands")
    buckets = bands.select(F.explode("bands").alias("key"), "node")
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("rep")).where("n > 1")
    buckets = written(buckets.join(shared, "key").select("key", "node", "rep"), "buckets")
    stars = written(buckets.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    members = written(buckets.select("node").distinct().join(bands.select("node", "tkey", "doc"), "node"), "members")
    sets = rows.join(small_side(members), ["tkey", "doc"]).select("node", "text")
    sets = written(sets.mapInArrow(_shingled(p.width), "node long, keys binary, times binary").dropDuplicates(["node"]), "sets")
    links = written(_verify(stars, sets, p), "links")
    joined = links.select("a", "b").unionByName(same_doc)
    label = connected_components(joined)
    component = F.coalesce("component", "node").alias("component")
    mixed = _mixed(buckets.select("key", "node").join(label, "node", "left").select("key", "node", component), "mixed")
    more = _rest(mixed, stars, bands, sets, p)
    if not more.isEmpty():
        links = links.unionByName(more)
        label = connected_components(joined.unionByName(more.select("a", "b")))
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("compared_links"))
    by_text = texts.join(label, "node", "left").join(degree, "node", "left").withColumn("component", component)
    if same_doc.isEmpty():
        by_text = by_text.withColumnRenamed("component", "class_id")  # every node is a least doc_id
    else:
        by_text = by_text.join(by_text.groupBy("component").agg(F.min("text_class").alias("class_id")), "component")
    by_text = written(by_text.select("tkey", "text_class", "class_id", F.coalesce("compared_links", F.lit(0).cast("long")).alias("compared_links")), "classes")
    discard(bands, buckets, stars, members, sets, mixed)
    return (
        sketched.select("doc", "tkey")
        .join(by_text, "tkey")
        .select(F.col("doc").alias("doc_id"), "class_id", "text_class", "compared_links", (F.col("doc") == F.col("class_id")).alias("kept"))
    )


def one_of_each(docs: DataFrame, p: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with their own columns; of rows that share a doc_id and text one stays.

    Texts are moved only for documents whose doc_id occurs more than once, and, where more documents go than
    are broadcast, to find those that do. Columns of docs keep their names, whatever they are; an empty table gives no rows.
    """
    found = written(near_duplicates(docs, p, id_col, text_col).select("doc_id", "kept"), "kept")
    lost = written(found.where("not kept").select("doc_id").distinct(), "lost")
    twice = written(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    rows = docs.select(_node(id_col, text_col).alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(small_side(lost), "doc_id", "left_anti")
    if not twice.isEmpty():
        twice = small_side(twice)
        again = rows.join(twice, "doc_id", "left_semi").withColumn("text", F.col(f"row.`{text_col}`")).dropDuplicates(["doc_id", "text"])
        rows = rows.join(twice, "doc_id", "left_anti").unionByName(again.select("doc_id", "row"))
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
