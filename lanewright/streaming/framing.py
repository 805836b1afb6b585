"""Framing of a stream of writes: an extension, as logs are complete files elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_stream(log: DataFrame, ts: str = "ts", frame: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """tune_id, reg, frame_start, val: the last write of each (tune, register) in windows of the length `frame`.

    log: tune_id, seq, reg, val and a timestamp. Writes that come later than `late` are left out by the watermark. State is
    one row for each open (tune, register, window). The same call works on a table, where nothing is late.
    """
    own = log.withWatermark(ts, late) if log.isStreaming else log
    last = F.max_by("val", F.struct(ts, "seq")).alias("val")
    return own.groupBy(F.window(ts, frame).alias("w"), "tune_id", "reg").agg(last).select("tune_id", "reg", F.col("w.start").alias("frame_start"), "val")
