"""Usage over event time; each function takes a batch or a streaming DataFrame.

An extension of the engine: the late-data handling is that of the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, watermark: str = "1 day", files_per_trigger: int = 4) -> DataFrame:
    """The event files of a folder as a stream; late rows beyond the watermark are dropped."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def hourly(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` per window; sliding if ``slide`` is given."""
    w = F.window(F.col("ts").cast("timestamp") if not events.isStreaming else F.col("ts"), width, slide)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``user_id, start, n``: sessions that end after a gap; the engine counts a row exactly at the gap to the next."""
    ts = F.col("ts").cast("timestamp") if not events.isStreaming else F.col("ts")
    w = F.session_window(ts, gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_deliveries(stream: DataFrame, key: str, arrived: str, watermark: str = "90 days") -> DataFrame:
    """A stream of records without the later deliveries of the same record."""
    return stream.withWatermark(arrived, watermark).dropDuplicatesWithinWatermark([key])


def new_files(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The segments of documents as they arrive in a folder; the query's checkpoint knows those already read."""
    from tmloom.sources.ingest import SCHEMA, parsed_batches

    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return raw.select("path", "content").mapInPandas(parsed_batches, SCHEMA)


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, history``: what was said before each turn of a conversation, in order, as it is replayed to a model.

    ``turns`` has ``conv_id, turn, role, text``.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)  # a conversation is short
    return turns.select("conv_id", "turn", F.collect_list(F.struct("role", "text")).over(w).alias("history"))


def changed_rows(stream: DataFrame, key: str, digest: str, forget_after: str | None = None):
    """Rows whose digest differs from the last one seen for their key, as a stateful operator.

    With ``forget_after`` (a duration) a key not seen for so long is forgotten, and its next
    row counts as changed; without it the state has one digest for each key for ever.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def keep(k, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        known, last = (True, state.get[0]) if state.exists else (False, None)
        for pdf in parts:
            if not len(pdf):
                continue
            before = pdf[digest].shift()
            differs = (pdf[digest] != before) & ~(pdf[digest].isna() & before.isna())
            first = pdf[digest].iloc[0]
            differs.iloc[0] = not known or not (first == last or (pd.isna(first) and last is None))
            known, last = True, None if pd.isna(pdf[digest].iloc[-1]) else pdf[digest].iloc[-1]
            yield pdf[differs]
        state.update((last,))
        if forget_after:
            state.setTimeoutDuration(forget_ms)

    forget_ms = int(pd.Timedelta(forget_after).total_seconds() * 1000) if forget_after else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(keep, stream.schema, "digest string", "append", timeout)
