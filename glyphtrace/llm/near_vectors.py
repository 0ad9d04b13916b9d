"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its `nearest` reference points (pivots) in order. Inverted lists, one per pivot, bring together
the vectors that share pivots; pairs that share at least `shared` of them are verified by their cosine in double
precision. Pivots are a bounded sample of the vectors, more for larger tables; every vector is indexed.

Equal vectors are one class with a count, so a vector that repeats very often costs one row. A long list is split by the
second pivot that its vectors share, so that candidates grow with the pairs of pivots and not with the pivots; what is
still long is cut into blocks that meet pairwise in tasks of their own, so no list has to fit in one task. Neither
changes which pairs meet. Vectors that are null, zero or hold
null or non-finite components, and those without an id, link with nothing and stand alone. A row that repeats a vec_id counts as
one vector more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphtrace.llm.common import Workspace, components, table
from glyphtrace.llm.vectors import by_dimension, sound, usable

#: Rows of one block of a list, and blocks from which on a list is split.
BLOCK, SPLIT = 384, 4
#: Pivots are broadcast: 8 MB at 64 dimensions.
MOST_PIVOTS = 1 << 14


def link_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, nearest: int = 8, shared: int = 2, rows_per_pivot: int = 48, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = df.sparkSession
    ws = Workspace(spark)
    # -0.0 is 0.0: grouping takes them as equal, the text that members are joined by would not
    vectors = usable(df, id_col, vector_col).filter("id is not null").withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    classes = ws.keep(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    members = ws.keep(vectors.select("id", F.md5(F.to_json("v")).alias("h")).join(classes.select(F.col("id").alias("rep"), "n", F.md5(F.to_json("v")).alias("h")), "h").select("id", "rep", "n"))
    n = classes.count()
    pivots = min(most_pivots, max(16, n // rows_per_pivot))
    # the classes with the smallest random keys
    sample = classes.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(pivots).select("id", "v").toArrow() if n else None
    points = {m.shape[1]: m / np.linalg.norm(m, axis=1, keepdims=True) for b in sample.combine_chunks().to_batches() for _, m in by_dimension(b)} if n else {}
    known = spark.sparkContext.broadcast(points)  # most_pivots vectors at most
    # single precision where the table has no more: half the bytes to move, the same values
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64

    def describe(batches):
        for b in batches:
            for rows, m in by_dimension(b) if b.num_rows else ():
                p = known.value.get(m.shape[1])
                d = m.shape[1]
                if p is None:  # no pivot has this dimension: one list for it
                    near = np.zeros((len(m), 1), np.int64)
                else:
                    k = min(nearest, len(p))
                    far = -((m / np.linalg.norm(m, axis=1, keepdims=True)) @ p.T)
                    near = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(p) else np.tile(np.arange(k), (len(m), 1))
                    near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
                near = near.astype(np.int32)
                raw = np.ascontiguousarray(m.astype(kind)).view(np.uint8).reshape(len(m), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, np.int32)), b["id"].take(pa.array(rows)), b["n"].take(pa.array(rows)), pa.array(list(near), pa.list_(pa.int32())), pa.array([x.tobytes() for x in raw], pa.binary())], names=["dim", "id", "n", "near", "v"])

    index = ws.keep(classes.select("id", "n", "v").mapInArrow(describe, "dim int, id long, n long, near array<int>, v binary"))
    spread = index.select("dim", F.explode("near").alias("pivot"), "id", "near")
    sizes = spread.groupBy("dim", "pivot").agg(F.count("*").alias("size"))
    # long lists are split by a second pivot; a pair meets under the two smallest that it shares
    splits = shared > 1
    listed = spread.join(F.broadcast(sizes), ["dim", "pivot"])  # a row for each pivot
    long = (F.col("size") > SPLIT * block) & (F.size("near") > 1) & F.lit(splits)
    seconds = F.filter("near", lambda x: x > F.col("pivot"))
    listed = listed.select("dim", "pivot", F.explode(F.when(long, seconds).otherwise(F.array(F.lit(-1)))).alias("second"), "id")
    per = listed.groupBy("dim", "pivot", "second").agg(F.count("*").alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = listed.join(per, ["dim", "pivot", "second"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block i meets block j in the task (i, j), i <= j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = own.select("*", other).select("dim", "pivot", "second", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
    dealt = dealt.join(index.select("id", "n", "near", "v"), "id")
    enough = shared

    def verify(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        d, i, j, pivot, second = (t[c][0].as_py() for c in ("dim", "i", "j", "pivot", "second"))
        ids, at = np.asarray(t["id"]), np.asarray(t["block"])
        v = np.frombuffer(b"".join(t["v"].to_pylist()), kind).reshape(len(ids), d).astype(np.float64)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = np.array(t["near"].to_pylist())
        a, b = np.flatnonzero(at == i), np.flatnonzero(at == j)
        x, y = np.nonzero(unit[a] @ unit[b].T >= threshold - 1e-9)
        x, y = a[x], b[y]
        keep = ids[x] < ids[y] if i == j else np.ones(len(x), bool)
        x, y = x[keep], y[keep]
        dot = np.einsum("ij,ij->i", v[x], v[y]) / (np.sqrt(np.einsum("ij,ij->i", v[x], v[x])) * np.sqrt(np.einsum("ij,ij->i", v[y], v[y])))
        common = np.concatenate([(near[x[k : k + 4096]][:, :, None] == near[y[k : k + 4096]][:, None, :]).any(2) for k in range(0, max(len(x), 1), 4096)])
        both = np.sort(np.where(common, near[x], np.iinfo(np.int32).max), axis=1)
        # a pair is told once, under the smallest pivots that it shares
        keep = (dot >= threshold) & (common.sum(1) >= min(enough, near.shape[1])) & (both[:, 0] == pivot)
        if second >= 0:
            keep &= both[:, 1] == second
        x, y = x[keep], y[keep]
        # per vector: how many others it links with here, and one edge that keeps what is linked together
        n = np.asarray(t["n"])
        others = np.bincount(x, n[y], len(ids)) + np.bincount(y, n[x], len(ids))
        label = ids.copy()
        while True:
            before = label.copy()
            np.minimum.at(label, x, label[y])
            np.minimum.at(label, y, label[x])
            if (label == before).all():
                break
        told = np.flatnonzero(others)
        return pa.table({"a": pa.array(ids[told]), "b": pa.array(label[told]), "others": pa.array(others[told].astype(np.int64))})

    links = ws.keep(dealt.groupBy("dim", "pivot", "second", "i", "j").applyInArrow(verify, "a long, b long, others long"))
    comp = components(ws, classes.select("id"), links)
    degree = links.groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    found = members.join(degree, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep")
    found = found.select(F.col("id").alias("vec_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.col("component").alias("component_id"))
    alone = df.filter(~sound(vector_col) | F.col(id_col).isNull()).select(F.col(id_col).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return ws.result(found.unionAll(alone).withColumn("kept", F.col("vec_id") == F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
