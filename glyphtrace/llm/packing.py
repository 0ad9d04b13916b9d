"""Vector best-fit packing of token pieces into sequences.

Texts become token ids and an end id; only documents longer than a sequence are cut, into whole sequences, the first
piece taking the remainder. Sequences have three capacities: tokens, documents, and attention cost (the sum of squared
lengths). Longest pieces first, each goes to the open sequence that keeps all three and has the largest weighted
dot-product of demand and filling, or the smallest weighted norm of what stays free.

The decision only depends on how many pieces there are of each length. So the driver gets that histogram (at most
`capacity` numbers, whatever the input), fits runs of equal pieces into runs of equal sequences, and the resulting
plan, a list of runs, is read by every task to place its own pieces by their rank among those of their length. The
packing is thus one over the whole corpus and not one per partition, and no task ever holds more than a batch. Pieces
that fill a sequence need no rank: each is one, under a negative number. The others are ranked within buckets that
pieces are dealt to in turn, so a length, id or text that very many of them share is no hot key.

By default only the tokens bind: a sequence of `capacity` tokens holds no more documents than that and no more attention
than their square. All three residuals count in the choice of the sequence.

Null text packs as an empty text (the end id alone); repeated rows are packed each; rows without an id are packed, too;
among pieces of one length ties go by id, piece and content; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphtrace.llm.common import Workspace, slices, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"
#: Pieces of one length are ranked within buckets of about so many pieces in all, BUCKETS of them at most.
BUCKET_ROWS, BUCKETS = 1 << 18, 1 << 16


@lru_cache(maxsize=2)
def encoding(path: str):
    """A byte-level BPE file of the tokenizers library, run by tiktoken, which is faster and gives the same ids."""
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in added}
    import public_tokenizers

    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 2) -> DataFrame:
    """One row per piece, without its place yet."""

    def run(batches):
        bpe, turn = encoding(vocabulary), 0
        for b in slices(batches):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = bpe.encode_ordinary(text or "")
                ids.append(end_id)
                raw, n = np.asarray(ids, "<u4").tobytes(), len(ids)
                at, k = 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity)
                    for name, x in zip(out, (doc, k, at, to - at, zlib.crc32(raw[4 * at : 4 * to])), strict=True):
                        out[name].append(x)
                    at, k = to, k + 1
            rows = len(out["doc_id"])
            bucket = ((turn + np.arange(rows)) * 40503 % BUCKETS).astype(np.int32)  # in turn, well apart
            turn += rows
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)), pa.array(bucket)], names=[*out, "bucket"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(histogram: dict[int, int], capacity: int, documents: int, attention: float, weights: tuple[float, float, float], score: str) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset, count): piece first rank + i of that length goes to sequence first sequence + i."""
    caps = np.array([capacity, documents, attention], float)
    w = np.array(weights, float)
    free = np.zeros((0, 3))  # of each run of alike sequences, relative to the capacities
    runs: list[list[int]] = []  # first sequence, count, tokens used
    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, float(length) ** 2])
        while left:
            fits = np.flatnonzero((free >= need).all(1)) if len(free) else []
            if len(fits):
                f = free[fits] / caps
                if score == "dot":
                    k = fits[int(np.argmax(((1 - f) * (need / caps)) @ w))]
                else:
                    k = fits[int(np.argmin((((f - need / caps) ** 2) @ w)))]
                first, count, used = runs[k]
                n = min(left, count)
                plan.append((length, rank, first, used, n))
                after = free[k] - need
                if n < count:
                    runs[k] = [first + n, count - n, used]
                    runs.append([first, n, used + length])
                    free = np.vstack([free, after])
                else:
                    runs[k], free[k] = [first, n, used + length], after
            else:
                # each new sequence takes as many of these pieces as fit, as best-fit would
                deep = max(1, int(min(capacity // length, documents, attention // max(1, length * length))))
                n = max(1, left // deep)
                plan.append((length, rank, opened, 0, n))
                runs.append([opened, n, length])
                free = np.vstack([free, caps - need])
                opened += n
            rank, left = rank + plan[-1][4], left - plan[-1][4]
        if len(free):  # full sequences leave
            open_ = free[:, 0] >= 1
            free, runs = free[open_], [r for r, o in zip(runs, open_, strict=True) if o]
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = 1024, documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), score: str = "norm", end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    pieces = ws.keep(token_pieces(docs, vocabulary or default_vocabulary(), capacity, end_id))
    full = (F.col("length") == capacity) & F.lit(capacity**2 <= (attention or float(capacity) ** 2))
    rest = pieces.filter(~full)
    sizes = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}  # `capacity` rows at most
    buckets = min(BUCKETS, max(16, sum(sizes.values()) // BUCKET_ROWS))
    plan = best_fit(sizes, capacity, documents or capacity, attention or float(capacity) ** 2, weights, score)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = spark.sparkContext.broadcast(plan[order])

    def place(batches):
        plan = shared.value
        key = (plan[:, 0] << 44) + plan[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (np.asarray(b[c]) for c in ("length", "rank"))
            row = plan[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "rank"), pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=[*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])

    rest = rest.withColumn("bucket", F.col("bucket") % buckets)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rest.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rest.withColumn("n", F.row_number().over(within) - 1).join(starts, ["length", "bucket"])  # dealt as the window is
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("n") + F.col("base")).alias("rank"))
    alone = pieces.filter(full).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return ws.result(placed.unionAll(alone))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
