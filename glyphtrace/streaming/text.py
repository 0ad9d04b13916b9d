"""Text signals over streams: the same column functions, stateless, and windowed counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphtrace.functions import severity, text


def signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with counts and severity; works on batch and streaming DataFrames alike."""
    out = df.withColumns({"zero_width": text.zero_width_count(text_col), "homoglyphs": text.homoglyph_count(text_col), "suspicious": text.suspicious_count(text_col), "trailing": text.trailing_lines(text_col), "mixed": text.mixed_line_endings(text_col)})
    return out.withColumn("severity", severity.base_severity(F.col("zero_width") + F.col("homoglyphs") + F.col("suspicious"), F.col("trailing"), F.col("mixed")))


def windowed(df: DataFrame, time_col: str, width: str = "10 minutes", late: str = "30 minutes", text_col: str = "text") -> DataFrame:
    """Rows and flagged rows per window of event time; rows later than `late` are left out, and state is bounded by it."""
    return signals(df.withWatermark(time_col, late), text_col).groupBy(F.window(time_col, width)).agg(F.count("*").alias("rows"), F.count_if(F.col("severity") != "clean").alias("flagged"))


def write_findings(df: DataFrame, path: str, checkpoint: str, text_col: str = "text"):
    """Appends flagged rows as Parquet, taking what is there now."""
    return signals(df, text_col).filter("severity <> 'clean'").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
