"""Live counters and logs: the drive watch as a stateful stream, pending records flushed in micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "drive string, ts timestamp, kind string, what string, was string, now string"
STATE = "cleaned boolean, links string, base_write bigint, base_read bigint, told_write bigint, told_read bigint"


def step(state: tuple | None, ts, cleaning: str | None, links: dict[str, str], write, read) -> tuple[tuple, list[tuple]]:
    """One poll: (new state, events). The first poll is the baseline. A cleaning request is told once, each change of a link's rate
    once, a link that vanishes once and then no more; links that appear later aren't adopted. Uncorrected errors are told as
    they climb over the baseline; a counter below it, or missing, says nothing and the baseline stays."""
    import json

    if state is None:
        told = [(ts, "cleaning", cleaning, None, "before")] if cleaning else []
        return (bool(cleaning), json.dumps(links), write, read, 0, 0), told
    cleaned, rates, base_write, base_read, told_write, told_read = state
    rates, out = json.loads(rates), []
    if cleaning and not cleaned:
        cleaned = True
        out.append((ts, "cleaning", cleaning, None, "running"))
    for link, was in sorted(rates.items()):
        now = links.get(link)
        if now is None:
            out.append((ts, "link", link, was, None))
            del rates[link]
        elif now != was:
            out.append((ts, "link", link, was, now))
            rates[link] = now
    rise = lambda base, now: now - base if base is not None and now is not None and now >= base else 0
    w, r = rise(base_write, write), rise(base_read, read)
    if w > told_write:
        out.append((ts, "errors", "write", str(told_write), str(w)))
        told_write = w
    if r > told_read:
        out.append((ts, "errors", "read", str(told_read), str(r)))
        told_read = r
    return (cleaned, json.dumps(rates), base_write, base_read, told_write, told_read), out


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    polls = pd.concat(list(batches)).sort_values("ts")
    held, out = (state.get if state.exists else None), []
    clean = lambda x: None if pd.isna(x) else int(x)
    for p in polls.itertuples(index=False):
        links = {x["link"]: x["rate"] for x in p.links} if p.links is not None else {}
        held, told = step(held, p.ts, p.cleaning or None, links, clean(p.write_uncorrected), clean(p.read_uncorrected))
        out += [(key[0], *t) for t in told]
    if held is not None:
        state.update(held)
    yield pd.DataFrame(out, columns=["drive", "ts", "kind", "what", "was", "now"])


def watch_drives(polls: DataFrame) -> DataFrame:
    """Events of a stream of polls (drive, ts, cleaning, links array<struct<link,rate>>, write_uncorrected, read_uncorrected).

    State is a few values for each drive, so it is bounded by the number of drives. Polls of a micro-batch are taken in order of ts.
    """
    rows = polls.select("drive", "ts", F.coalesce("cleaning", F.lit("")).alias("cleaning"), "links", F.col("write_uncorrected").cast("long"), F.col("read_uncorrected").cast("long"))
    return rows.groupBy("drive").applyInPandasWithState(_watch, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def _flush(threshold: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, segment = state.get if state.exists else (0, 1)
        rows = pd.concat(list(batches)).sort_values("line_no")
        out = []
        for r in rows.itertuples(index=False):
            held += int(r.size)
            out.append((key[0], r.path, int(r.line_no), int(r.size), segment))
            if held >= threshold:
                held, segment = 0, segment + 1
        state.update((held, segment))
        yield pd.DataFrame(out, columns=["tape_id", "path", "line_no", "size", "segment"])

    return run


def assign_segments(pending: DataFrame, threshold: int) -> DataFrame:
    """The segment of each pending record (tape_id, path, line_no, size) of a stream: a new one once threshold bytes are reached."""
    rows = pending.select("tape_id", "path", "line_no", F.col("size").cast("long"))
    return rows.groupBy("tape_id").applyInPandasWithState(_flush(threshold), "tape_id string, path string, line_no long, size long, segment int", "held long, segment int", "append", GroupStateTimeout.NoTimeout)


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream so that a replayed batch changes nothing: each batch overwrites a folder of its own number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["tape_id", "path", "line_no"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_replays(rows: DataFrame) -> DataFrame:
    """Records once each: the same location and content recorded twice is harmless."""
    return rows.dropDuplicates(["tape_id", "path", "sha256"])
