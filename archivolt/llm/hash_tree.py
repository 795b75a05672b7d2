"""Sharding by a hierarchical weighted hash tree: weighted hash draws choose region, rack and shard. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """shards: their number; racks of per_rack shards, regions of per_region racks, filled in order of shard number.

    weight: shard -> weight where it isn't 1; a rack weighs as its shards, a region as its racks, places for shards still to
    come included. arrivals: draws of the last region while such places are left.
    slices: parts of a shard whose rows are numbered apart and then laid end to end.
    """

    shards: int = 24
    per_rack: int = 4
    per_region: int = 2
    weight: dict[int, float] = field(default_factory=dict)
    slices: int = 64
    arrivals: int = 16

    def regions(self) -> dict[int, dict[int, dict[int, float]]]:
        out: dict[int, dict[int, dict[int, float]]] = {}
        room = self.per_rack * self.per_region
        for s in range(-(-self.shards // room) * room):
            rack = s // self.per_rack
            out.setdefault(rack // self.per_region, {}).setdefault(rack, {})[s] = self.weight.get(s, 1.0)
        return out

    def unfilled(self) -> bool:
        """Whether the last region has places without a shard."""
        return self.shards % (self.per_rack * self.per_region) > 0


def total(node) -> float:
    """The weight of a node of regions()."""
    return node if isinstance(node, float) else sum(map(total, node.values()))


def uniform(key: Column, name: str) -> Column:
    """A double in (0, 1) from a key and the name of a node: 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def drawn(key: Column, weights: dict[str, float]) -> Column:
    """The index of the node with the least -ln(u) / weight: each is drawn in proportion to its weight. If a weight rises,
    keys move to that node only; if it falls, from that node only."""
    costs = [-F.log(uniform(key, name)) / w for name, w in weights.items()]
    if len(costs) == 1:
        return F.lit(0)
    structs = F.array(*(F.struct(c.alias("cost"), F.lit(i).alias("at")) for i, c in enumerate(costs)))
    return F.array_min(structs)["at"]


def descend(key: Column, racks: dict[int, dict[int, float]]) -> Column:
    """The shard, or place for one, that a region's racks and the shards of the drawn rack come down to."""
    rack = drawn(key, {f"rack{x}": total(shards) for x, shards in racks.items()})
    out = None
    for i, shards in enumerate(racks.values()):
        shard = F.element_at(F.array(*map(F.lit, shards)), drawn(key, {f"shard{s}": w for s, w in shards.items()}) + 1)
        out = shard if out is None else F.when(rack == i, shard).otherwise(out)
    return out


def arrived(key: Column, tree: Tree, region: int) -> Column:
    """(t, slot) of the first arrival of a region that meets a shard; slot is null if none of tree.arrivals does.

    Arrivals are a Poisson process whose rate is the weight of the whole region, each with a descent of its own. The first
    one is the draw of a region without unfilled places, so filling a place changes rows that come to meet it and no other.
    """
    racks = tree.regions()[region]

    def one(j: Column) -> Column:
        k = F.when(j == 0, key).otherwise(F.concat(key, F.lit("#"), j.cast("string")))
        return F.struct((-F.log(uniform(k, f"region{region}")) / total(racks)).alias("gap"), descend(k, racks).alias("slot"))

    def after(found: Column, x: Column) -> Column:
        slot = F.when(x["slot"] < tree.shards, x["slot"])
        return F.when(found["slot"].isNotNull(), found).otherwise(F.struct((found["t"] + x["gap"]).alias("t"), slot.alias("slot")))

    none = F.struct(F.lit(0.0).alias("t"), F.lit(None).cast("int").alias("slot"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(tree.arrivals - 1)), one), none, after)


def add_levels(rows: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """rows with the shard as an int column `name`. Each level draws once, among the children of the node above only.

    Nodes are known by their numbers, so a subtree whose weights don't change draws as before: a change
    of weights moves rows into or out of changed subtrees alone. One more shard takes rows only into itself, for every number
    of shards: the last region is drawn as if it were filled, and drawn again where the draw meets no shard, see arrived().
    In a first region that isn't filled, rows that tree.arrivals draws leave without a shard go to shard 0.
    """
    regions, k = tree.regions(), F.col(key)
    *filled, last = list(regions)
    if not tree.unfilled():
        filled.append(last)
    costs = [(-F.log(uniform(k, f"region{r}")) / total(regions[r])) for r in filled]
    if tree.unfilled():
        rows = rows.withColumn("__late", arrived(k, tree, last))
        costs.append(F.when(F.col("__late.slot").isNotNull(), F.col("__late.t")).otherwise(F.lit(float("inf"))))
    at = F.array_min(F.array(*(F.struct(c.alias("cost"), F.lit(i).alias("at")) for i, c in enumerate(costs))))["at"] if len(costs) > 1 else F.lit(0)
    rows = rows.withColumn("__region", at)
    out = F.coalesce(F.col("__late.slot"), F.lit(0)) if tree.unfilled() else descend(k, regions[filled[-1]])
    for i, r in list(enumerate(filled))[:: -1][0 if tree.unfilled() else 1 :]:
        out = F.when(F.col("__region") == i, descend(k, regions[r])).otherwise(out)
    return rows.withColumn(name, out.cast("int")).drop("__region", "__late")


def shard_documents(docs: DataFrame, tree: Tree = Tree(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    size: UTF-8 bytes of the text plus 8; text_crc32: unsigned, of the UTF-8 text (null as empty for both). law is
    `key`: doc_id and the tree decide alone, so equal ids share a shard and a hot source or text spreads like any other.
    grown_shard: the shard with one more of weight 1; it differs from shard only where it is the new one. Texts are taken whole,
    however long. Columns of docs with other names are ignored. slot: 0, 1, .. within a shard without gaps, by slice (a draw
    of doc_id), doc_id, size and crc; repeated rows get slots of their own. A null doc_id is one key. An empty table gives no rows.

    Only 28 bytes a row are shuffled. A shard's rows are numbered in slices, whose counts (shards x slices rows) are
    broadcast, so no task holds a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("__key", keys).withColumn("__slice", F.floor(uniform(F.col("__key"), "slice") * tree.slices).cast("int"))
    rows = add_levels(rows, "__key", tree, "shard")
    grown = replace(tree, shards=tree.shards + 1)
    ids = docs.select(keys.alias("__key") if id_col == "doc_id" else F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__key"))
    ids = add_levels(ids.withColumn("__slice", F.floor(uniform(F.col("__key"), "slice") * tree.slices).cast("int")), "__key", tree, "shard")
    counts = ids.groupBy("shard", "__slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = add_levels(rows, "__key", grown, "grown_shard").drop("__key")
    order = Window.partitionBy("shard", "__slice").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("__at", F.row_number().over(order) - 1).join(F.broadcast(counts), ["shard", "__slice"])
    rack = F.floor(F.col("shard") / tree.per_rack).cast("int")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("__at")).cast("long").alias("slot"), "grown_shard",
        F.floor(rack / tree.per_region).cast("int").alias("region"), rack.alias("rack"),
    )


def _cost_sql(key: str, name: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5({key} || '/{name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {weight}"


def _descend_sql(key: str, racks: dict) -> str:
    def level(kids: dict, prefix: str, below) -> str:
        if len(kids) == 1:
            return below(next(iter(kids.items())))
        draws = "[" + ", ".join(_cost_sql(key, f"{prefix}{k}", total(w)) for k, w in kids.items()) + "]"
        arms = " ".join(f"WHEN {i + 1} THEN {below(item)}" for i, item in enumerate(kids.items()))
        return f"CASE list_position({draws}, list_min({draws})) {arms} END"

    return level(racks, "rack", lambda x: level(x[1], "shard", lambda s: str(s[0])))


def _arrivals_sql(tree: Tree, tag: str) -> str:
    """Columns gaps_.. and slots_.. of the last region's arrivals."""
    region, racks = list(tree.regions().items())[-1]
    k = "(CASE WHEN j = 0 THEN key ELSE key || '#' || j END)"
    each = f"list_transform(range(0, {tree.arrivals}), lambda j: "
    return f"{each}{_cost_sql(k, f'region{region}', total(racks))}) AS gaps_{tag}, {each}{_descend_sql(k, racks)}) AS slots_{tag}"


def _shard_sql(tree: Tree, tag: str) -> str:
    """A DuckDB expression of key, and of times_.. and slots_.. where a region isn't filled."""
    regions = list(tree.regions().items())
    costs, arms = [], []
    for i, (r, racks) in enumerate(regions, 1):
        late = tree.unfilled() and i == len(regions)
        costs.append(f"coalesce(list_min(times_{tag}), 'inf'::DOUBLE)" if late else _cost_sql("key", f"region{r}", total(racks)))
        arms.append(f"WHEN {i} THEN " + (f"coalesce(slots_{tag}[list_position(times_{tag}, list_min(times_{tag}))], 0)" if late else _descend_sql("key", racks)))
    draws = "[" + ", ".join(costs) + "]"
    return f"CAST(CASE list_position({draws}, list_min({draws})) {' '.join(arms)} END AS INTEGER)"


def oracle(tree: Tree = Tree()) -> str:
    both = {"now": tree, "grown": replace(tree, shards=tree.shards + 1)}
    arrivals = "".join(f", {_arrivals_sql(t, tag)}" for tag, t in both.items() if t.unfilled())
    times = "".join(f", list_transform(range(1, {t.arrivals + 1}), lambda i: CASE WHEN slots_{tag}[i] < {t.shards} THEN list_sum(gaps_{tag}[1:i]) END) AS times_{tag}" for tag, t in both.items() if t.unfilled())
    return f"""
        WITH octets AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
        bits AS (
            SELECT list(v ORDER BY i) AS t
            FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) r(i)))),
        keyed AS (
            SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, CAST(strlen(text) + 8 AS BIGINT) AS size,
                   xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substring(h, 2 * i - 1, 2))::BIGINT)),
                                   lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
            FROM octets, bits),
        arriving AS (SELECT *{arrivals} FROM keyed),
        timed AS (SELECT *{times} FROM arriving),
        placed AS (
            SELECT doc_id, size, text_crc32, {_shard_sql(tree, "now")} AS shard, {_shard_sql(both["grown"], "grown")} AS grown_shard,
                   floor((('0x' || substr(md5(key || '/slice'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 * {tree.slices}) AS slice
            FROM timed)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, size, text_crc32) - 1 AS slot,
               CAST(shard // {tree.per_rack * tree.per_region} AS INTEGER) AS region, CAST(shard // {tree.per_rack} AS INTEGER) AS rack
        FROM placed
    """
