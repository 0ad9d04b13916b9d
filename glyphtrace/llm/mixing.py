"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

Each source gets a target number of words. Every document of a source is first taken floor(target / source words)
times, certainly and whole; what is left of the target is drawn by Pareto order sampling: documents are ranked by their
random odds over their inclusion odds, and the first ones are taken whole until the words nearest the rest are reached.

Null text has size 0, null sources form one source (last in order), an empty table gives an empty result, and of
documents with equal ranks the smaller id comes first. A document without an id is drawn by a hash of its text.
Repeated rows are ranked alike and taken alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphtrace.llm.common import Workspace, table

#: A source table of more rows than this is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Rank ranges of one level of the search for the last document taken.
RANGES = 1024


def _size(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): water-filling of share * all words by weight, no target above most * source words."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("cap", cap).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    level = (F.lit(float(share)) * F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    # the level of the first source that stays below its cap holds for it and all after it
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), "level"))).over(Window.partitionBy())
    return per.select("source", "source_size", F.coalesce(F.least("cap", first["level"] * F.col("w")), F.col("cap")).alias("target"))


def _joined(df: DataFrame, per: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    per = per.withColumnRenamed("source", "source_")
    return df.join(F.broadcast(per) if small else per, df["source"].eqNullSafe(per["source_"]), how).drop("source_")


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their certain copies (whole), and, where their source draws more, their rank, its ranges (r1, r2) and the words to draw (rest)."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio).cast("long")).withColumn("part", ratio - F.floor(ratio))
    odds = (F.col("random") / (1 - F.col("random"))) / (F.col("part") / (1 - F.col("part")))
    rows = rows.withColumn("rank", F.when(F.col("part") > 0, odds / (1 + odds))).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return rows.withColumn("r1", F.floor(F.col("rank") * RANGES)).withColumn("r2", F.floor(F.col("rank") * RANGES * RANGES))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, salt: str = "") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, row): how many words of each document the mix takes, in whole copies; row is the document."""
    ws = Workspace(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(docs["text"], F.lit(""))))
    random = (F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    sizes = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col("source"), _size().alias("size"), random.alias("random"))
    # what the search reads is written step by step: as one plan it would hold the targets and all sums a dozen times over
    drawn = ws.keep(sizes.drop("row"))
    per = ws.keep(source_targets(drawn, weights, share, most))
    small = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    # the words before each document in rank order, from sums over ever finer ranges of ranks: no task sees a whole source
    ranked = _ranked(_joined(drawn, per, small)).filter("rank is not null")
    one = ranked.groupBy("source", "r1", "rest").agg(F.sum("size").alias("s"))
    w1 = Window.partitionBy("source").orderBy("r1").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("upto", F.sum("s").over(w1))
    edge1 = one.filter("upto > rest").groupBy("source").agg(F.min(F.struct("r1", (F.col("upto") - F.col("s")).alias("before"))).alias("e"))
    edge1 = ws.keep(edge1.select("source", F.col("e.r1").alias("e1"), F.col("e.before").alias("b1")))
    inner = _joined(ranked, edge1, small).filter("r1 = e1")
    two = inner.groupBy("source", "r2", "rest", "b1").agg(F.sum("size").alias("s"))
    w2 = Window.partitionBy("source").orderBy("r2").rowsBetween(Window.unboundedPreceding, 0)
    two = two.withColumn("upto", F.col("b1") + F.sum("s").over(w2))
    edge2 = two.filter("upto > rest").groupBy("source").agg(F.min(F.struct("r2", (F.col("upto") - F.col("s")).alias("before"))).alias("e"))
    edge2 = ws.keep(edge2.select("source", F.col("e.r2").alias("e2"), F.col("e.before").alias("b2")))
    last = _joined(inner, edge2, small).filter("r2 = e2")
    w3 = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.col("b2") + F.sum("size").over(w3)).filter("upto - size / 2 <= rest")
    last = last.groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("last"))
    ends = per
    for found in (edge1.select("source", "e1"), edge2.select("source", "e2"), last):
        ends = _joined(ends, found, small, "left")
    ends = ws.keep(ends)
    ws.leave(ends)
    ws.restore()
    out = _ranked(_joined(sizes, ends, small))
    chosen = F.when(F.col("rank").isNull(), False).when(F.col("e1").isNull() | (F.col("r1") < F.col("e1")), True).when(F.col("r1") > F.col("e1"), False)
    chosen = chosen.when(F.col("e2").isNull() | (F.col("r2") < F.col("e2")), True).when(F.col("r2") > F.col("e2"), False)
    chosen = chosen.otherwise(F.coalesce(F.struct("rank", "doc_id") <= F.col("last"), F.lit(False)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + chosen.cast("long"))).alias("taken"), (F.col("whole") + chosen.cast("long")).alias("copies"), "row")



def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of documents, each as often as it is taken."""
    rows = mix_sources(docs, **options).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies", "row")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
q AS (SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w, 2e0 * source_size AS cap,
             sum(source_size) OVER () AS total FROM p),
r AS (SELECT *, (1.5e0 * total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
l AS (SELECT level FROM r WHERE level * w < cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l) * w), cap) AS target FROM r),
u AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS ratio,
             (('0x' || substr(md5(d.doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5e0) / 281474976710656e0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, (u / (1 - u)) / ((ratio - floor(ratio)) / (1 - (ratio - floor(ratio)))) AS odds, target - floor(ratio)::BIGINT * source_size AS rest FROM u),
w AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM v)
SELECT doc_id, size, source_size, target,
       (size * (floor(ratio)::BIGINT + CASE WHEN ratio > floor(ratio) AND upto - size / 2e0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM w
"""
