"""What the corpus operators share: written intermediate tables, bounded batches, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, whichever are reached first; Spark's own defaults hold 64 MB of text at once, in
#: buffers that an executor keeps.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}
#: UTF-8 bytes of text that one numpy pass works on; what a pass holds in memory is a fixed multiple of it.
SLICE_BYTES = 192 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where the session names none and runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="glyphtrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call in the shared folder.

    keep() writes a DataFrame as Parquet and reads it again, which cuts the lineage so that lost executors cost no more
    than the stage at hand. result() writes the last one, removes the others and gives the session its own batch size
    back; an operator that returns what is still to be computed leaves BATCH.
    """

    def __init__(self, spark: SparkSession):
        self.before = {k: spark.conf.get(k) for k in BATCH}
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        self.spark, self.at, self.paths = spark, f"{shared_folder(spark)}/glyphtrace-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{len(self.paths)}"
        self.paths.append(path)
        df.write.parquet(path)
        # Spark deletes the shuffle files of finished work once the driver has collected what refers to them
        self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._glyphtrace_path = path
        return out

    def done(self, kept: DataFrame) -> None:
        """Removes a table that nothing to come reads."""
        _remove(self.spark, kept._glyphtrace_path)

    def drop(self, *frames_before: int) -> None:
        for k in frames_before:
            _remove(self.spark, self.paths[k])

    def result(self, df: DataFrame) -> DataFrame:
        out = self.keep(df)
        self.leave(out)
        self.restore()
        return out

    def restore(self) -> None:
        """Gives the session its own batch size back."""
        for k, v in self.before.items():
            self.spark.conf.set(k, v)

    def leave(self, *kept: DataFrame) -> None:
        """Removes all tables but these, which go when the session ends."""
        stay = {k._glyphtrace_path for k in kept if hasattr(k, "_glyphtrace_path")}
        for path in self.paths:
            if path not in stay:
                _remove(self.spark, path)
        atexit.register(_remove, self.spark, self.at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: what is left goes with its folder
        pass


def give_back() -> None:
    """Returns what a task has freed to the system: workers live on beside others, and idle ones would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column holds about `limit` bytes; a longer text stands alone, whole."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(b[column]), 0)).astype(np.int64)
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)
    give_back()


def numbered(ws: Workspace, docs: DataFrame, id_col: str) -> DataFrame:
    """id, and the columns of docs in row_. Ids tell rows apart; where ids repeat or lack, rows are numbered in a written copy, so that the numbers stay."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row_")
    if docs.agg(F.count("*") == F.count_distinct(id_col)).first()[0]:
        return docs.select(F.col(id_col).cast("long").alias("id"), row)
    return ws.keep(docs.select(F.monotonically_increasing_id().alias("id"), row))


def apart(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is not among `ids` for certain, and the others, few more than those that are: only these need a join."""
    held = rows.sparkSession.sparkContext.broadcast(id_bitmap(ids.select("id")))  # bounded, see id_bitmap

    def side(which: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(in_bitmap(held.value, np.asarray(b["id"])) == which))

        return run

    return rows.mapInArrow(side(False), rows.schema), rows.mapInArrow(side(True), rows.schema)


def components(ws: Workspace, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node reaches by edges (a, b), by alternating large and small stars.

    Every step is a grouped minimum and one join, so a node with very many edges is never gathered in one task.
    """
    pairs = ws.keep(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct())
    mark = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        pairs = ws.keep(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.select("id").join(pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))


#: Numbers in one row of a dense sum on its way to the driver.
_CHUNK = 1024


def dense_sum(df: DataFrame, per_task, length: int, kind=np.float64, chunk: int = _CHUNK) -> np.ndarray:
    """The sum over all tasks of a vector of fixed length: per_task(batches) gives one for its task.

    Only `length` numbers reach the driver, however large the input; each task sends its own vector in pieces, which
    are added up by grouped tasks; larger pieces suit tables of few tasks.
    """

    def run(batches):
        total = np.asarray(per_task(batches), kind)
        keep = [k for k in range(0, length, chunk) if total[k : k + chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k // chunk for k in keep], pa.int32()), pa.array([total[k : k + chunk].tobytes() for k in keep], pa.binary())], names=["chunk", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind) for x in t["part"].to_pylist())
        return pa.table({"chunk": pa.array([t["chunk"][0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(length, kind)
    for k, part in df.mapInArrow(run, "chunk int, part binary").groupBy("chunk").applyInArrow(add, "chunk int, part binary").collect():
        out[k * chunk : k * chunk + len(part) // np.dtype(kind).itemsize] = np.frombuffer(part, kind)
    return out


#: Bits of a set of ids that is sent to every task: 32 for each id up to these bounds (128 MB). A fuller set only lets
#: more ids through, which later joins remove.
LEAST_BITS, MOST_BITS = 16, 30


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return ((ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A superset of the column `id`, as bits; at most 2 ** MOST_BITS of them, whatever the number of ids."""
    chunk = 1 << 16
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * ids.count()).bit_length()))

    def run(batches):
        slots = [np.unique(_slot(np.asarray(b["id"]), bits)) for b in batches]
        slots = np.unique(np.concatenate(slots)) if slots else np.zeros(0, np.int64)
        used, first = np.unique(slots // chunk, return_index=True)
        parts = [x.astype(np.uint16).tobytes() for x in np.split(slots % chunk, first[1:])] if len(used) else []
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(parts, pa.binary())], names=["chunk", "part"])

    def either(t: pa.Table) -> pa.Table:
        held = np.zeros(chunk, np.uint8)
        for x in t["part"].to_pylist():
            held[np.frombuffer(x, np.uint16)] = 1
        return pa.table({"chunk": pa.array([t["chunk"][0].as_py()], pa.int32()), "part": pa.array([np.packbits(held).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, part in ids.mapInArrow(run, "chunk int, part binary").groupBy("chunk").applyInArrow(either, "chunk int, part binary").collect():
        out[k * chunk // 8 : (k + 1) * chunk // 8] = np.frombuffer(part, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _slot(ids, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
