"""Quality rules by host: failure rates per host, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.llm.common import Words, fields_of, is_small, packed, slices, sums_by, texts_of, written

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class HostRules:
    """Limits of the document rules and of the hosts' shrunk failure rates.

    A document fails its own rules outright (base) below min_words words or when more than
    max_repeat percent of its words lie in repeated 3-word windows. The softer rules (symbols per 100 words,
    repeated lines per 100 lines, mean word length) count against its host only. A host whose shrunk failure
    rate exceeds suspect loses the documents that fail a softer rule; above blocked it loses all.
    """

    min_words: int = 50
    max_repeat: int = 50
    max_symbols: int = 10
    max_dup_lines: int = 30
    min_mean: int = 2
    max_mean: int = 14
    suspect: float = 0.5
    blocked: float = 0.8
    max_strength: float = 1000.0
    salts: int = 64

    def base_failed(self):
        return (F.col("n_words") < self.min_words) | (100 * F.col("n_repeat_words") > self.max_repeat * F.col("n_words"))

    def soft_failed(self):
        return (
            (100 * F.col("n_symbols") > self.max_symbols * F.col("n_words"))
            | (100 * F.col("n_dup_lines") > self.max_dup_lines * F.col("n_lines"))
            | (F.col("word_chars") < self.min_mean * F.col("n_words"))
            | (F.col("word_chars") > self.max_mean * F.col("n_words"))
        )


def repeated_words(words: Words, n: int) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found at least twice in it."""
    out = np.zeros(n, np.int64)
    number = np.maximum(words.counts - 2, 0)
    doc = np.repeat(np.arange(n), number)
    if not len(doc):
        return out
    at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(words.starts, number)
    code, size = words.codes, max(len(words.dictionary), 1)
    pair = code[at] * size + code[at + 1]
    if size >= 1 << 21:  # three codes would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = np.unique(pair * size + code[at + 2], return_inverse=True)[1]
    _, inverse, times = np.unique(doc * (int(window.max()) + 1) + window, return_inverse=True, return_counts=True)
    hit = at[times[inverse] > 1]
    marked = np.zeros(len(code), bool)
    for j in range(3):
        marked[hit + j] = True
    return sums_by(words.doc[marked], np.ones(int(marked.sum())), n)


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    n, words = len(texts), Words(texts)
    chars = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(words.dictionary, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.split_pattern(texts, "\n")
    encoded = lines.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    has_word = pc.match_substring_regex(encoded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    keep = has_word[codes] if len(codes) else np.zeros(0, bool)
    of, codes = of[keep], codes[keep]
    n_lines = np.bincount(of, minlength=n)
    distinct = np.bincount(np.unique(of * max(len(encoded.dictionary), 1) + codes) // max(len(encoded.dictionary), 1), minlength=n)
    return {
        "n_words": words.counts,
        "word_chars": sums_by(words.doc, chars[words.codes] if len(chars) else words.codes, n),
        "n_symbols": sums_by(words.doc, symbols[words.codes] if len(symbols) else words.codes, n),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeated_words(words, n),
    }


def _measured(text_at: int, keep: list[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                found = measures(texts_of(part, text_at))
                yield pa.RecordBatch.from_arrays([fields_of(part.column("row"), keep), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["row", *MEASURES])

    return run


def measured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) packed into a struct `row` (so no name can clash), and the measures of text_col beside it."""
    rows, at = packed(docs, text_col)
    places = None if keep is None else [docs.columns.index(c) for c in keep]
    fields = rows.schema["row"].dataType.fields
    row = T.StructField("row", T.StructType(fields if places is None else [fields[i] for i in places]))
    return rows.mapInArrow(_measured(at, places), T.StructType([row, *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def host_table(found: DataFrame, rules: HostRules) -> DataFrame:
    """host, n, failed, shrunk, verdict from rows of (host, failed).

    The prior is a beta distribution by moments: its mean m is the rate over all documents, its strength s = 1 / rho - 1
    follows from the correlation rho of failures within hosts, by analysis of variance: with S the sum of
    n (rate - m)^2, N the documents and k the hosts, rho = (S / (m (1 - m)) - (k - 1)) / (N - sum(n^2) / N - (k - 1)).
    Weighting by n keeps very many tiny hosts from hiding the large ones. s is held within 1 .. max_strength.
    """
    hosts = written(found.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")), "hosts")
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    prior = hosts.agg(F.sum(n).alias("N"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff"), F.count("*").alias("k"))
    m, more = F.col("f") / F.col("N"), F.col("k") - 1
    above = (F.col("ff") - F.col("f") * m) / F.nullif(m * (1 - m), F.lit(0.0)) - more
    room = F.col("N") - F.col("nn") / F.col("N") - more
    rho = F.when((room > 0) & (above > 0), F.least(above / room, F.lit(1.0)))
    strength = F.coalesce(F.least(F.greatest(1 / rho - 1, F.lit(1.0)), F.lit(rules.max_strength)), F.lit(rules.max_strength))
    found = prior.where("N > 0").select(m.alias("m"), strength.alias("s")).first()  # two numbers
    mean, strength = (F.lit(found.m), F.lit(found.s)) if found else (F.lit(0.0), F.lit(rules.max_strength))
    shrunk = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    verdict = F.when(F.col("shrunk") > rules.blocked, "blocked").when(F.col("shrunk") > rules.suspect, "suspect").otherwise("trusted")
    return hosts.withColumn("shrunk", shrunk).select("host", "n", "failed", "shrunk", verdict.alias("verdict"))


def host_quality(docs: DataFrame, rules: HostRules = HostRules(), host_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep, host_col among them) packed as `row`, with the measures, base_failed, soft_failed, verdict (of the host) and kept.

    kept is false if base_failed, if the host is blocked, or if it is suspect and a softer rule fails.
    Null and empty texts have no words and fail. Rows without a host form one group of their own. Repeated rows
    count each. Columns of docs stay in `row` under their own names. An empty table gives no rows.

    Only hosts that aren't trusted are joined back: broadcast if at most 200,000, else salted, so that a host with
    a third of all rows is spread over many tasks.
    """
    found = measured(docs, text_col, keep).withColumn("host", F.coalesce(F.col(f"row.`{host_col}`").cast("string"), F.lit("\x00")))
    found = written(found.withColumn("base_failed", rules.base_failed()).withColumn("soft_failed", rules.soft_failed()), "measured")
    hosts = host_table(found.select("host", (F.col("base_failed") | F.col("soft_failed")).alias("failed")), rules)
    bad = written(hosts.where("verdict <> 'trusted'").select("host", "verdict"), "bad_hosts")
    if is_small(bad):
        joined = found.join(F.broadcast(bad), "host", "left")
    else:
        salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))))
        joined = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(rules.salts)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    verdict = F.coalesce("verdict", F.lit("trusted"))
    lost = F.col("base_failed") | (verdict == "blocked") | ((verdict == "suspect") & F.col("soft_failed"))
    return joined.select("row", *MEASURES, "base_failed", "soft_failed", verdict.alias("verdict"), (~lost).alias("kept"))


def kept_documents(docs: DataFrame, rules: HostRules = HostRules(), host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that host_quality() keeps, with their own columns."""
    return host_quality(docs, rules, host_col, text_col).where("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
