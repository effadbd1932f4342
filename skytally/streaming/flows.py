"""Structured Streaming versions: windows, sessions, state by aircraft, guards and idempotent writes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def fresh(stream: DataFrame, now: Column, limits_s: dict[str, int]) -> DataFrame:
    """Observations that are not too old when they come in, by where they come from."""
    limit = F.coalesce(*(F.when(F.col("origin") == origin, s) for origin, s in limits_s.items()))
    return stream.where(F.unix_micros(now) - F.unix_micros("observed_at") <= limit * 1_000_000)


def hourly_counts(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Available and captured positions of each hour and origin's bucket (column bucket)."""
    hours = stream.withWatermark("observed_at", delay).groupBy(F.window("observed_at", "1 hour").alias("w"), "bucket")
    return hours.agg(F.count("*").alias("available"), F.sum("captured").alias("captured")).select(F.col("w.start").alias("hour"), "bucket", "available", "captured")


def gap_flights(stream: DataFrame, gap_s: int = 600, delay: str = "10 minutes") -> DataFrame:
    """Flights of each aircraft, closed when nothing came for more than ``gap_s``."""
    # A gap of the very length ends nothing.
    window = F.session_window("observed_at", f"{gap_s * 1_000_000 + 1} microseconds")
    runs = stream.withWatermark("observed_at", delay).groupBy("icao_hex", window.alias("w"))
    return runs.agg(F.count("*").alias("positions"), F.min("observed_at").alias("start_time"), F.max("observed_at").alias("end_time"), F.nullif(F.max("altitude_ft"), F.lit(0)).alias("max_altitude")).drop("w")


def once(stream: DataFrame, uid: str, delay: str = "1 hour") -> DataFrame:
    """Messages by their id once, as far back as the watermark."""
    return stream.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark([uid])


def last_known(stream: DataFrame, keep_s: int = 60, delay: str = "0 seconds") -> DataFrame:
    """The last record of each aircraft (icao_hex, observed_at, altitude_ft) as it changes; ``gone`` when nothing came for ``keep_s``.

    Older records than what is known change nothing; what is null leaves the known value.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, altitude = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="us"), altitude, True)], columns=["icao_hex", "observed_at", "altitude_ft", "gone"])
            return
        at, altitude = state.get if state.exists else (-1, None)
        for rows in batches:
            for r in rows.sort_values("observed_at").itertuples(index=False):
                us = int(r.observed_at.value // 1000)
                if us >= at:
                    at, altitude = us, altitude if pd.isna(r.altitude_ft) else int(r.altitude_ft)
        state.update((at, altitude))
        state.setTimeoutTimestamp(max(at // 1000 + keep_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="us"), altitude, False)], columns=["icao_hex", "observed_at", "altitude_ft", "gone"])

    by_key = stream.select("icao_hex", "observed_at", "altitude_ft").withWatermark("observed_at", delay).groupBy("icao_hex")
    return by_key.applyInPandasWithState(run, "icao_hex string, observed_at timestamp, altitude_ft long, gone boolean", "at long, altitude long", "update", GroupStateTimeout.EventTimeTimeout)


def hysteresis(evaluations: DataFrame, open_hits: int = 2, close_misses: int = 3) -> DataFrame:
    """Anomalies by key from evaluations (key, tick, hit): open after some hits, closed after misses in a row.

    Hits before it opens are not undone by a miss.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, misses, is_open = state.get if state.exists else (0, 0, False)
        changes = []
        for rows in batches:
            for r in rows.sort_values("tick").itertuples(index=False):
                hits, misses = (hits + 1, 0) if r.hit else (hits, misses + 1)
                if not is_open and hits >= open_hits:
                    is_open = True
                    changes.append((key[0], int(r.tick), "opened"))
                elif is_open and misses >= close_misses:
                    hits, misses, is_open = 0, 0, False
                    changes.append((key[0], int(r.tick), "closed"))
        state.update((hits, misses, is_open))
        yield pd.DataFrame(changes, columns=["key", "tick", "change"])

    return evaluations.groupBy("key").applyInPandasWithState(run, "key string, tick long, change string", "hits long, misses long, open boolean", "append", GroupStateTimeout.NoTimeout)


def drop_guard(snapshots: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """Whether each snapshot (origin, tick, aircraft) may remove what it lacks.

    A sudden drop to ``share`` of a baseline of ``least`` or more is deferred for one
    snapshot: the next one confirms it, or shows that it recovered.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        baseline, waiting = state.get if state.exists else (-1, False)
        out = []
        for rows in batches:
            for r in rows.sort_values("tick").itertuples(index=False):
                dropped = baseline >= least and r.aircraft <= baseline * (1 - share)
                if dropped and not waiting:
                    out.append((key[0], int(r.tick), "deferred"))
                    waiting = True
                    continue
                out.append((key[0], int(r.tick), ("confirmed" if dropped else "recovered") if waiting else "pruned"))
                baseline, waiting = int(r.aircraft), False
        state.update((baseline, waiting))
        yield pd.DataFrame(out, columns=["origin", "tick", "decision"])

    return snapshots.groupBy("origin").applyInPandasWithState(run, "origin string, tick long, decision string", "baseline long, waiting boolean", "append", GroupStateTimeout.NoTimeout)


def write_once(batch: DataFrame, batch_id: int, folder: str) -> None:
    """A micro-batch as the folder of its number: a batch that is run again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, written batch by batch to the shared folder; the rows of the last batch in complete mode, of all otherwise."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, n: write_once(batch, 0 if mode == "complete" else n, f"{folder}/rows")).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.names)
