"""Streaming forms of the catalogue's operators; each gives what its batch form gives over the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators.catalogue import MAX_TRAVEL_TIME


def read_detections(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def uptime(detections: DataFrame, ts: str = "ts", sta: str = "sta") -> DataFrame:
    """Hours with any detection, final once later ones can't change them."""
    late = detections.withWatermark(ts, f"{MAX_TRAVEL_TIME} seconds")
    return late.groupBy(F.window(ts, "1 hour"), sta).agg(F.count("*").alias("n_arrivals")).select(sta, F.col("window.start").alias("hour"), "n_arrivals")


def sliding_maxima(detections: DataFrame, x: str, ts: str = "ts", length: str = "5 seconds", step: str = "0.5 seconds") -> DataFrame:
    late = detections.withWatermark(ts, f"{MAX_TRAVEL_TIME} seconds")
    return late.groupBy(F.window(ts, length, step)).agg(F.max(x).alias("most"), F.count("*").alias("n"))


def blocks(detections: DataFrame, gap: str = "10 seconds", ts: str = "ts", sta: str = "sta") -> DataFrame:
    """Detections of a station closer than gap are one block."""
    late = detections.withWatermark(ts, f"{MAX_TRAVEL_TIME} seconds")
    return late.groupBy(F.session_window(ts, gap), sta).agg(F.count("*").alias("n")).select(sta, F.col("session_window.start").alias("stime"), F.col("session_window.end").alias("etime"), "n")


def suppressed(detections: DataFrame, seconds: float = 50.0, ts: str = "ts", sta: str = "sta", score: str = "score") -> DataFrame:
    """The first best-scored detection of each run of detections of a station at most ``seconds`` apart. State is one
    row for each station; a run is given out when the watermark has passed it."""

    def step(key, batches, state):
        from pyspark.sql.streaming.state import GroupStateTimeout  # noqa: F401

        held = list(state.get) if state.exists else None
        out = []
        rows = [r for pdf in batches for r in zip(pdf["_t"], pdf[score])]
        for t, s in sorted(rows):
            if held and t - held[1] <= seconds:
                held = [held[0], max(t, held[1]), s, t, held[4] + 1] if s > held[2] else [held[0], max(t, held[1]), held[2], held[3], held[4] + 1]
            else:
                if held:
                    out.append(held)
                held = [t, t, s, t, 1]
        if state.hasTimedOut and held:
            out.append(held)
            held = None
        if held:
            state.update(tuple(held))
            state.setTimeoutTimestamp(max(int((held[1] + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], h[3], h[2], h[4]) for h in out], columns=["sta", "t", "score", "n"])

    timed = detections.withWatermark(ts, f"{MAX_TRAVEL_TIME} seconds").withColumn("_t", F.unix_micros(ts) / 1e6)
    return timed.groupBy(F.col(sta).alias("sta")).applyInPandasWithState(step, "sta long, t double, score double, n long", "first double, last double, score double, t double, n long", "append", "EventTimeTimeout")


def in_blocks(detections: DataFrame, block: Column) -> DataFrame:
    """Counts of a period's blocks (``functions.blocks``), which change while detections come: the last block may be longer than any watermark waits, so they are to be
    kept as snapshots. Detections outside the period are left out."""
    return detections.select(block.alias("_b")).where("_b IS NOT NULL").groupBy(F.col("_b.block").alias("block"), F.col("_b.stime").alias("stime"), F.col("_b.etime").alias("etime")).agg(F.count("*").alias("n"))


def followed(events: DataFrame, detections: DataFrame, seconds: int, ts: str = "ts", sta: str = "sta") -> DataFrame:
    """Pairs of an event and a detection of its station at most ``seconds`` after it, from two streams. Watermarks and the bounds let either side's state go
    once no partner can come any more."""
    late = f"{MAX_TRAVEL_TIME} seconds"
    a = events.withWatermark(ts, late).withColumnsRenamed({ts: "event_ts", sta: "event_sta"})
    b = detections.withWatermark(ts, late)
    return b.join(a, F.expr(f"{sta} = event_sta AND {ts} >= event_ts AND {ts} <= event_ts + INTERVAL {seconds} SECONDS"))


def finished(stream: DataFrame, path: str) -> DataFrame:
    """A stream's appended rows, once it has read all there is."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def snapshots(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """A stream of counts that change, kept as a table: each batch adds its changed rows with its number, and of a key the last batch's row counts. A batch that is
    repeated after a failure replaces what it wrote."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{path}/rows")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in values))
