"""Statistics of least significant bits over pixels(channel, row, col, v) as grouped aggregations: any number of pixels per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Normal quantile at which the chi-square survival function (Wilson-Hilferty) passes 0.30.
Z_LIMIT = 0.5244005127080407


def chi_square(pixels: DataFrame) -> DataFrame:
    """channel, chi_sq, df, suspicious: are the values 2k and 2k + 1 too equally frequent?"""
    even, odd = F.sum(F.when(F.col("v") % 2 == 0, F.col("n")).otherwise(0)), F.sum(F.when(F.col("v") % 2 == 1, F.col("n")).otherwise(0))
    pairs = pixels.groupBy("channel", "v").agg(F.count("*").alias("n")).groupBy("channel", F.floor(F.col("v") / 2).alias("k")).agg(even.alias("e"), odd.alias("o"))
    mean = (F.col("e") + F.col("o")) / 2.0
    part = F.when(mean >= 1.0, (F.col("e") - mean) * (F.col("e") - mean) / mean + (F.col("o") - mean) * (F.col("o") - mean) / mean)
    out = pairs.groupBy("channel").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("chi_sq"), F.greatest(F.count(part) - 1, F.lit(1)).alias("df"))
    h = F.lit(2.0) / (F.lit(9.0) * F.col("df"))
    z = (F.pow(F.col("chi_sq") / F.col("df"), F.lit(1.0) / F.lit(3.0)) - (F.lit(1.0) - h)) / F.sqrt(h)
    return out.withColumn("suspicious", z < Z_LIMIT)


def sample_pairs(pixels: DataFrame) -> DataFrame:
    """channel, w, x, y, z (counts of horizontal pairs), estimate, suspicious."""
    u, v = F.col("v"), F.lead("v").over(Window.partitionBy("channel", "row").orderBy("col"))
    pairs = pixels.select("channel", u.alias("u"), v.alias("v")).filter("v is not null")
    eu, ev = F.col("u") - F.col("u") % 2, F.col("v") - F.col("v") % 2
    kind = F.when(eu == ev, "w").when(F.abs(F.col("u") - F.col("v")) == 1, "x").when(eu == ev - 2, "y").when(ev == eu - 2, "z")
    counts = pairs.groupBy("channel").agg(*[F.count_if(kind == k).alias(k) for k in "wxyz"])
    total = F.col("w") + F.col("x") + F.col("y") + F.col("z")
    share = lambda k: F.col(k) / total
    below = F.lit(2.0) * (share("w") - share("y") - share("z") + share("x"))
    raw = F.when((total > 0) & (F.abs(below) >= 1e-10), share("x") / below)
    sound = F.when(raw.between(0.0, 1.0), raw)
    return counts.withColumn("estimate", sound).withColumn("suspicious", F.coalesce(sound > 0.15, F.lit(False)))


def regular_singular(pixels: DataFrame, corrected: bool = False) -> DataFrame:
    """channel, r_m, s_m, r_n, s_n, estimate, suspicious: regular and singular groups of two under both flips.

    By default the second flip equals the first, so the estimate is 0; corrected=True uses the shifted one (2k - 1 with 2k).
    """
    a, b = F.col("v"), F.lead("v").over(Window.partitionBy("channel", "row").orderBy("col"))
    groups = pixels.select("channel", "col", a.alias("a"), b.alias("b")).filter("col % 2 = 0 and b is not null")
    flip = F.col("a").bitwiseXOR(F.lit(1))
    shifted = F.when(F.col("a") % 2 == 0, F.col("a") - 1).otherwise(F.col("a") + 1) if corrected else flip
    change = lambda to: F.abs(to - F.col("b")) - F.abs(F.col("a") - F.col("b"))
    share = lambda test, name: (F.count_if(test) / F.count("*")).alias(name)
    out = groups.groupBy("channel").agg(share(change(flip) > 0, "r_m"), share(change(flip) < 0, "s_m"), share(change(shifted) > 0, "r_n"), share(change(shifted) < 0, "s_n"))
    below = F.lit(2.0) * ((F.col("r_m") - F.col("s_m")) + (F.col("r_n") - F.col("s_n")))
    estimate = F.when(F.abs(below) > 1e-10, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("r_m") - F.col("r_n")) + (F.col("s_n") - F.col("s_m"))) / below))).otherwise(0.0)
    return out.withColumn("estimate", estimate).withColumn("suspicious", F.col("estimate") > 0.15)


def _binary_entropy(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), -(p * F.log2(p) + (F.lit(1.0) - p) * F.log2(F.lit(1.0) - p))).otherwise(0.0)


def block_entropy(pixels: DataFrame) -> DataFrame:
    """channel, blocks, block_mean, block_variance of the entropy of the lowest bits in whole square blocks; no row without one."""
    size = pixels.groupBy("channel").agg((F.max("col") + 1).alias("width"), F.count_distinct("row").alias("rows"))
    size = size.withColumn("side", F.greatest(F.lit(4), F.least(F.lit(16), F.floor(F.col("width") / 2))))
    numbered = pixels.select("channel", "row").distinct().withColumn("r", F.row_number().over(Window.partitionBy("channel").orderBy("row")) - 1)
    inside = (F.col("r") < F.floor(F.col("rows") / F.col("side")) * F.col("side")) & (F.col("col") < F.floor(F.col("width") / F.col("side")) * F.col("side"))
    laid = pixels.join(numbered, ["channel", "row"]).join(size, "channel").filter(inside)
    blocks = laid.groupBy("channel", F.floor(F.col("r") / F.col("side")).alias("x"), F.floor(F.col("col") / F.col("side")).alias("y")).agg((F.sum(F.col("v") % 2) / F.count("*")).alias("p"))
    h = blocks.select("channel", _binary_entropy(F.col("p")).alias("h"))
    return h.groupBy("channel").agg(F.count("*").alias("blocks"), F.avg("h").alias("block_mean"), F.var_pop("h").alias("block_variance"))


def entropy(pixels: DataFrame) -> DataFrame:
    """channel, n, balance, entropy, suspicious: are the lowest bits as good as random? Images without a whole block have a looser test."""
    out = pixels.groupBy("channel").agg(F.count("*").alias("n"), (F.sum(F.col("v") % 2) / F.count("*")).alias("balance"), (F.max("col") + 1).alias("width"))
    p, side = F.col("balance"), F.greatest(F.lit(4), F.least(F.lit(16), F.floor(F.col("width") / 2)))
    whole = (F.col("width") >= side) & (F.floor(F.col("n") / F.col("width")) >= side)
    out = out.withColumn("entropy", _binary_entropy(p)).withColumn("whole", whole)
    sure = (F.col("entropy") >= 0.9999) & (p > 0.49) & (p < 0.51)
    return out.withColumn("suspicious", (F.col("n") >= 64) & F.when(F.col("whole"), sure).otherwise(F.col("entropy") > 0.95)).drop("width", "whole")


def palette_bits(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """channel, colours, entropy, sorted, usage_cv, suspicious of indexed images; palette: channel, entry, r, g, b."""
    light = F.lit(0.299) * F.col("r") + F.lit(0.587) * F.col("g") + F.lit(0.114) * F.col("b")
    lit = palette.select("channel", light.alias("l"), F.lead(light).over(Window.partitionBy("channel").orderBy("entry")).alias("next"))
    tables = lit.groupBy("channel").agg(F.count("*").alias("colours"), F.count_if(F.col("l") > F.col("next")).alias("falls"))
    counts = pixels.groupBy("channel", "v").agg(F.count("*").alias("n")).join(tables.select("channel", "colours"), "channel")
    used = F.when(F.col("v") < F.least("colours", F.lit(256)), F.col("n"))
    use = counts.groupBy("channel").agg(F.count(used).alias("kinds"), F.avg(used).alias("mean"), F.stddev_pop(used).alias("dev"), F.sum("n").alias("size"), (F.sum(F.when(F.col("v") % 2 == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("p"))
    out = use.join(tables, "channel").select(
        "channel", "colours", "size", _binary_entropy(F.col("p")).alias("entropy"), (F.col("falls") < F.greatest(F.lit(1.0), F.col("colours") * 0.05)).alias("sorted"),
        F.when(F.col("kinds") > 1, F.col("dev") / F.greatest(F.col("mean"), F.lit(1.0))).otherwise(1.0).alias("usage_cv"),
    )
    doubtful = (F.col("colours") >= 8) & (F.col("size") >= 16) & (F.col("entropy") > 0.92) & (F.col("sorted") | (F.col("usage_cv") < 0.3))
    return out.withColumn("suspicious", doubtful).drop("size")


def vote(pixels: DataFrame, palette: DataFrame | None = None, corrected: bool = False) -> DataFrame:
    """channel, votes, suspicious: two of the tests agree; four of them, and a fifth for channels that are indices of a palette."""
    tests = [chi_square(pixels), sample_pairs(pixels), entropy(pixels), regular_singular(pixels, corrected)]
    if palette is not None:
        tests.append(palette_bits(pixels, palette))
    parts = [t.select("channel", F.col("suspicious").cast("int").alias("s")) for t in tests]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("channel").agg(F.sum("s").alias("votes")).withColumn("suspicious", F.col("votes") >= 2)


def verdict(channels: DataFrame, id_cols: list[str]) -> DataFrame:
    """id, suspicious_channels, verdict, confidence from rows (id, suspicious)."""
    out = channels.groupBy(*id_cols).agg(F.count_if("suspicious").alias("suspicious_channels"))
    n = F.col("suspicious_channels")
    name = F.when(n == 0, "CLEAN").when(n <= 2, "SUSPICIOUS").otherwise("LIKELY_STEGO")
    sure = F.when(n == 0, 0.0).when(n == 1, 0.45).when(n == 2, 0.65).otherwise(F.least(F.lit(0.99), F.lit(0.80) + (n - 3) * F.lit(0.06)))
    return out.select(*id_cols, n, name.alias("verdict"), sure.alias("confidence"))
