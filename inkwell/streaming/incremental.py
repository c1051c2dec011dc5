"""Incremental runs: file streams with checkpoints, resume by key, and revision series with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fixed as X


def stream_jsonl(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New JSON lines files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def run_available(stream: DataFrame, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str) -> None:
    """Process what is there, append the results as Parquet, and stop.

    Each batch drops keys that the sink already holds, so a restart with a lost checkpoint adds nothing twice;
    keys that gave no row stay open for a later batch run.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        rows = resume(batch, _sink(spark, sink, key), key)
        step(rows).write.mode("append").parquet(sink)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _sink(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select(key).distinct()
    except AnalysisException:  # nothing written yet
        return None


def resume(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key isn't done."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def paste_state(stream: DataFrame, key: str) -> DataFrame:
    """Running paste totals per key of a revision stream (key, minutes, chars): the last sample and the sums are
    the state; every batch emits the keys that it touched."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chars, minutes, total, pasted = state.get if state.exists else (None, None, 0, 0)
        rows = pd.concat(list(batches)).dropna(subset=["minutes", "chars"]).sort_values(["minutes", "chars"])
        for c, m in zip(rows["chars"], rows["minutes"]):
            if chars is not None:
                added = max(0, int(c) - chars)
                total += added
                if added >= X.PASTE_CHARS and added / max(m - minutes, 1e-6) > X.PASTE_RATE:
                    pasted += added
            chars, minutes = int(c), float(m)
        state.update((chars, minutes, total, pasted))
        yield pd.DataFrame({key: [name[0]], "paste_score": [pasted / total if total else -1.0]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {dict(stream.dtypes)[key]}, paste_score double", "chars long, minutes double, total long, pasted long", "update", "NoTimeout")


def pending_units(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units (name, requires array) that aren't done and whose requirements all are."""
    open_ = units.join(done.select("name"), "name", "left_anti")
    need = open_.select("name", F.explode("requires").alias("_r"))
    blocked = need.join(done.select(F.col("name").alias("_r")), "_r", "left_anti").select("name").distinct()
    return open_.join(blocked, "name", "left_anti")
