"""Mixing sources: tempered token shares, the exponent found by bisection, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.common import small_side, written


@dataclass(frozen=True)
class Mix:
    """Target of the mixture.

    Weights go as share^a, 0 <= a <= 1. entropy: the least entropy of the weights as a part of log(number of
    sources); None: as flat as max_repeats lets. max_repeats: the most passes over any source; it wins over entropy.
    span_bits: blocks are added up in 2^span_bits ranges of their draws. budget: tokens to give out; None: the least budget at which no source falls short of one whole pass, so that
    nothing is dropped. block_tokens: mean size of a block. rounds x step: the exponent is cut into `step` parts
    `rounds` times, log2(step) bisections in each job.
    """

    entropy: float | None = 0.95
    max_repeats: float = 2.0
    budget: int | None = None
    block_tokens: int = 1_000_000
    seed: int = 1
    rounds: int = 4
    step: int = 32
    span_bits: int = 10


def tokens(text) -> Column:
    """Tokens of a text, taken as its UTF-8 bytes / 4, rounded up; 1 at least, so that empty texts have a place too."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long"), F.lit(1).cast("long"))


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The largest exponent at which the weights reach the entropy, then raised as far as max_repeats asks.

    sources: a written table of (source, tokens). Both measures fall or rise steadily in the exponent, so each job
    evaluates a ladder of exponents in one aggregate and keeps the rung between which the target lies.
    """
    top = sources.agg(F.max("tokens").alias("t"), F.min("tokens").alias("least"), F.count("*").alias("k")).first()
    if not top.k or top.t == top.least:
        return 1.0

    def ladder(low: float, high: float) -> list[float]:
        return [low + (high - low) * i / mix.step for i in range(mix.step + 1)]

    def entropies(rungs: list[float]) -> list[float]:
        x = F.log(F.col("tokens") / float(top.t))
        row = sources.agg(*(F.sum(F.exp(a * x)).alias(f"s{i}") for i, a in enumerate(rungs)), *(F.sum(a * x * F.exp(a * x)).alias(f"e{i}") for i, a in enumerate(rungs))).first()
        return [math.log(row[f"s{i}"]) - row[f"e{i}"] / row[f"s{i}"] for i in range(len(rungs))]

    # with the least whole budget the largest source is passed once and the smallest (t / least)^(1 - a) times
    floor = max(0.0, 1 - math.log(mix.max_repeats) / math.log(top.t / top.least))
    if mix.entropy is None:
        return floor
    low, high = 0.0, 1.0
    for _ in range(mix.rounds):
        rungs = ladder(low, high)
        good = [i for i, h in enumerate(entropies(rungs)) if h >= mix.entropy * math.log(top.k) - 1e-12]
        i = max(good, default=0)
        low, high = rungs[i], rungs[min(i + 1, mix.step)]
    return max(low, floor)


def weights(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, tokens, weight, quota): quota tokens of the budget go to the source, as quota / tokens passes."""
    a = exponent(sources, mix)
    power = F.pow(F.col("tokens").cast("double"), F.lit(a))
    total = sources.agg(F.sum(power).alias("z")).first().z or 1.0
    out = sources.withColumn("weight", power / F.lit(total))
    budget = mix.budget if mix.budget is not None else out.agg(F.max(F.col("tokens") / F.col("weight")).alias("b")).first().b or 0.0
    quota = F.least(F.round(F.col("weight") * F.lit(float(budget))), F.floor(F.col("tokens") * F.lit(mix.max_repeats))).cast("long")
    return out.select("source", "tokens", "weight", quota.alias("quota"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixture: docs packed as `row`, with source, tokens, pass (0, 1, ..) and block; a row for each pass that takes it.

    Each pass over a source is a permutation of its blocks, drawn anew from (seed, pass); a row's block in a pass
    follows from its id_col, text and seed. A source gets whole passes, then whole blocks of one more pass while they
    fit into its quota, then rows of the next block, in the order of its own permutation, while they fit.
    The quota is missed by less than one document. With no budget given every row is taken once at least.

    A null source is a source of its own; null and empty texts count one token, very long ones are counted whole. Repeated rows are taken each, in an
    order among themselves that doesn't matter. Other columns stay in `row`; an empty table gives no rows.
    Only the boundary block of each source, about block_tokens in size, is ever ordered row by row.
    """
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\x00"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), source.alias("source"), tokens(F.col(f"`{text_col}`")).alias("tokens"))
    sizes = docs.select(source.alias("source"), tokens(F.col(f"`{text_col}`")).alias("tokens"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"))
    sources = written(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    plan = written(
        weights(sources, mix).select(
            "source",
            (F.floor(F.col("quota") / F.col("tokens"))).cast("int").alias("whole"),
            (F.col("quota") % F.col("tokens")).alias("rest"),
            F.greatest(F.ceil(F.col("tokens") / mix.block_tokens), F.lit(1)).cast("long").alias("blocks"),
        ),
        "plan",
    )
    by_source = small_side(plan)

    def drawn(df: DataFrame) -> DataFrame:
        """Adds the pass that is taken in part, and each row's block and place in it."""
        draw = F.xxhash64(F.lit(mix.seed), F.col("whole"), F.col("key"))
        return df.join(by_source, "source").withColumn("place", draw).withColumn("block", F.pmod(F.xxhash64(draw), F.col("blocks")))

    part = drawn(sizes).where("rest > 0")
    block = part.groupBy("source", "block", "whole", "rest").agg(F.sum("tokens").alias("tokens"))
    # blocks in the order of their draws; the draws' ranges are added up first, so no task orders all blocks of a source
    draw = F.xxhash64(F.lit(mix.seed), F.col("whole"), F.col("block"))
    block = written(block.withColumn("draw", draw).withColumn("span", F.shiftright("draw", 64 - mix.span_bits)), "block_sizes")
    ahead = Window.unboundedPreceding, -1
    spans = block.groupBy("source", "span").agg(F.sum("tokens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("span").rowsBetween(*ahead)), F.lit(0))
    spans = written(spans.select("source", "span", earlier.alias("earlier")), "spans")
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "span").orderBy("draw", "block").rowsBetween(*ahead)), F.lit(0))
    block = block.withColumn("within", within).join(small_side(spans), ["source", "span"]).withColumn("before", F.col("earlier") + F.col("within"))
    block = written(block.where("before < rest"), "blocks")
    edge = block.where(F.col("before") + F.col("tokens") > F.col("rest")).select("source", "block", (F.col("rest") - F.col("before")).alias("room"))
    edges = small_side(edge)
    line = Window.partitionBy("source", "block").orderBy("place", "tokens")
    filled = F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, 0))
    cut = part.join(edges, ["source", "block"]).withColumn("filled", filled).where(F.col("filled") <= F.col("room"))
    cut = written(cut.groupBy("source", "block").agg(F.max(F.struct("place", "tokens")).alias("last")), "cut")
    limit = block.join(cut, ["source", "block"], "left").select(
        "source", "block", (F.col("before") + F.col("tokens") <= F.col("rest")).alias("all"), F.col("last.place").alias("last")
    )
    taken = written(limit.where("all or last is not null"), "taken")
    takes = small_side(taken)

    rows = drawn(packed.withColumn("key", F.xxhash64(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"))))
    fits = F.col("all") | (F.col("last").isNotNull() & (F.col("place") <= F.col("last")))
    rows = rows.join(takes, ["source", "block"], "left").withColumn("more", F.coalesce(fits, F.lit(False)))
    passes = F.when(F.col("more"), F.col("whole") + 1).otherwise(F.col("whole"))
    rows = rows.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    at = F.pmod(F.xxhash64(F.xxhash64(F.lit(mix.seed), F.col("pass"), F.col("key"))), F.col("blocks"))
    return rows.select("row", "source", "tokens", "pass", at.alias("block"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of mix_sources() with the columns of docs; a row that several passes take comes that often."""
    return mix_sources(docs, mix, source_col, id_col, text_col).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
