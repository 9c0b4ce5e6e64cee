"""The gap split on a stream (an extension: the batch engine has no streams of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_totals(fixes: DataFrame, gap_s: int = 300, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of fixes (track, ts, z): a gap of more than gap_s starts a new one; state goes with the watermark."""
    window = F.session_window("ts", f"{gap_s} seconds 1 microsecond")
    return fixes.withWatermark("ts", late).groupBy("track", window.alias("w")).agg(F.count("*").alias("fixes"), F.min("ts").alias("start"), F.max("ts").alias("end"))
