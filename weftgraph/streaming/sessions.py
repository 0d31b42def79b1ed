"""Streams: sessions of events, running coverage, and mapping of files as they come."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key on a stream or a table: events less than `gap` apart are one session. On a stream,
    state is dropped once the watermark has passed a session."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("st"), F.col("s.end").alias("en"), "n")


def coverage_totals(steps: DataFrame) -> DataFrame:
    """Covered length of each segment so far; on a stream to be written in complete or update mode."""
    return steps.groupBy("seg").agg(F.sum(F.col("en") - F.col("st")).alias("covered"), F.count(F.lit(1)).alias("n"))


def map_stream(records: DataFrame, mapper: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Maps each micro-batch of a stream of sequences and writes its alignments. A batch goes to a folder of its
    own number, so a batch that is run again after a failure replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        mapper(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_in_order(records: DataFrame, source: str, number: str, out: str, checkpoint: str):
    """Writes each source's records in the order of their numbers, which count from 0 without gaps, however late one comes:
    state by source holds back what an earlier record is missing for. A number that comes again changes nothing.

    out: folders batch=k, whose rows have `written`, the record's place in the order; a batch that is run again after a
    failure starts from the state before it and replaces its folder. Held rows are the state's size."""
    import pandas as pd

    names = records.columns
    kinds = dict(records.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def release(key, batches, state):
        wanted, held = (state.get if state.exists else (0, b""))
        rows = [pd.DataFrame(batch) for batch in batches]
        if held:
            rows.insert(0, pickle.loads(held))
        every = pd.concat(rows, ignore_index=True)
        every = every[every[number] >= wanted].drop_duplicates(number).sort_values(number, ignore_index=True)
        ready = int((every[number] == wanted + every.index).cumprod().sum())
        rest = every.iloc[ready:]
        state.update((wanted + ready, pickle.dumps(rest) if len(rest) else b""))
        now = every.iloc[:ready].copy()
        now["written"] = range(wanted, wanted + ready)
        yield now[[*names, "written"]]

    ordered = records.groupBy(source).applyInPandasWithState(release, f"{fields}, written long", "wanted long, held binary", "append", GroupStateTimeout.NoTimeout)

    def one(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")

    return ordered.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
