"""Severity, flags and family severities as Column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_severity(hidden: Column, trailing: Column, mixed: Column, lsb: Column | None = None) -> Column:
    """clean, low, medium, high or critical from a weighted score."""
    lsb = F.lit(False) if lsb is None else lsb
    score = hidden + trailing * 0.5 + F.when(mixed, 5).otherwise(0) + F.when(lsb, 8).otherwise(0)
    return F.when(score == 0, "clean").when(score >= 20, "critical").when(score >= 8, "high").when(score >= 2, "medium").otherwise("low")


def severity(base: Column, attention: Column) -> Column:
    """Findings that need attention lift a severity to high."""
    return F.when(attention & base.isin("clean", "low", "medium"), "high").otherwise(base)


def zero_width_severity(count: Column, kinds: Column) -> Column:
    return F.when((count >= 20) | (kinds >= 3), "HIGH").when((count >= 5) | (kinds >= 2), "MEDIUM").otherwise("LOW")


def homoglyph_severity(count: Column, scripts: Column) -> Column:
    return F.when((count >= 5) | (scripts >= 2), "HIGH").when(count >= 2, "MEDIUM").otherwise("LOW")


def suspicious_severity(count: Column, override: Column, direction: Column) -> Column:
    return F.when(override, "CRITICAL").when(direction | (count >= 5), "HIGH").when(count >= 2, "MEDIUM").otherwise("LOW")


def trailing_severity(kinds: Column, longest: Column, total: Column) -> Column:
    return F.when((kinds <= 3) | (longest >= 8) | (total >= 30), "HIGH").when((longest >= 4) | (total >= 12), "MEDIUM").otherwise("LOW")


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: total, flagged, incomplete, completed, clean."""
    return verdicts.agg(
        F.count("*").alias("total"), F.count_if("flagged").alias("flagged"), F.count_if("incomplete").alias("incomplete"),
        F.count_if(~F.col("incomplete")).alias("completed"), F.count_if(~F.col("flagged") & ~F.col("incomplete")).alias("clean"),
    )


def exit_code(summary_row) -> int:
    """2 without results or with incomplete ones, 1 with flagged ones, else 0."""
    if not summary_row["total"] or summary_row["incomplete"]:
        return 2
    return 1 if summary_row["flagged"] else 0


def metrics(rows: DataFrame) -> DataFrame:
    """family (null: all), samples, tp, tn, fp, fn, precision, recall, false_positive_rate, false_negative_rate of rows (family, expected, observed)."""
    e, o = F.col("expected"), F.col("observed")
    out = rows.groupingSets([["family"], []], "family").agg(F.count("*").alias("samples"), F.count_if(e & o).alias("tp"), F.count_if(~e & ~o).alias("tn"), F.count_if(~e & o).alias("fp"), F.count_if(e & ~o).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return out.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), ratio("fp", "tn").alias("false_positive_rate"), ratio("fn", "tp").alias("false_negative_rate"))
