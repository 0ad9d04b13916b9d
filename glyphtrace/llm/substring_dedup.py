"""Removal of long passages that an earlier document holds, by suffix automata of reference shards.

The reference is the earlier documents themselves, so shipping every automaton to every document would cost the square
of the corpus. Instead documents are routed to the shards that can matter to them:

1. Winnowed word n-grams of every document: two documents that share a window of `window` words share one of them.
2. The windows around shared n-grams, hashed; for each window that several documents hold, the smallest id owns it.
3. A reference shard is the passages that one document owns, those of a very long one by stretches of SHARD words. Its
   suffix automaton is replicated to as many tasks as the documents routed to it need, which stream through it; their
   matching statistics tell the spans of at least `window` words, and those are removed.

The hashes only route; what is removed is what the automata match. Documents with equal words are one document up to
routing: all but the smallest id go, if they have `window` words. All steps are grouped minima, joins and sorted
streams, so a passage that very many documents share is spread over tasks.

Null and empty texts keep nothing and lose nothing. Rows that repeat a doc_id are alike and get alike results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace.llm.automaton import SuffixAutomaton
from glyphtrace.llm.common import Workspace, id_bitmap, in_bitmap, slices, table
from glyphtrace.llm.kernels import Words, minimizers, mix, ragged, signed

#: Documents that stream through one replica of a shard's automaton.
STREAM = 128
#: Words of a document whose windows make one shard, which bounds an automaton whatever the length of texts.
SHARD = 1 << 16


def _per_text(text: np.ndarray, values: np.ndarray, texts: int):
    """Distinct values of each text as (values, how many per text)."""
    order = np.lexsort((values, text))
    t, v = text[order], values[order]
    head = np.ones(len(t), bool)
    head[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return v[head], np.bincount(t[head], minlength=texts)


def repeated_spans(ws: Workspace, docs: DataFrame, *, window: int = 50, gram: int = 16, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(every document: doc_id, n_words, whole_sha256, copy of an earlier one or not; spans: doc_id, spans of words to remove)."""
    spark = docs.sparkSession
    width = window - gram + 1

    def describe(batches):
        for b in slices(batches):
            w = Words(b["text"])
            texts = len(w.first) - 1
            g, valid = w.grams(gram)
            _, whole = w.grams(window)
            at = minimizers(g, valid, width, whole)
            fps, size = _per_text(w.text_of_word()[at], g[at], texts)
            sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in b["text"].to_pylist()]
            k = w.whole()
            sums = np.concatenate([[0], np.cumsum(mix(w.hash ^ np.uint64(0x5DEECE66D)))]).astype(np.uint64)
            k2 = sums[w.first[1:]] - sums[w.first[:-1]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(w.count), pa.array(signed(k)), pa.array(signed(k2)), pa.array(sha), ragged(signed(fps), size)], names=["doc_id", "n_words", "k1", "k2", "sha", "fps"])

    all_ = ws.keep(docs.mapInArrow(describe, "doc_id long, n_words long, k1 long, k2 long, sha string, fps array<long>"))
    first = all_.filter(F.col("n_words") >= window).groupBy("n_words", "k1", "k2").agg(F.min("doc_id").alias("first"))
    known = ws.keep(all_.select("doc_id", "n_words", "k1", "k2", "sha").join(first, ["n_words", "k1", "k2"], "left").select("doc_id", "n_words", "sha", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy")))
    fps = all_.select("doc_id", "fps").join(known.filter(~F.col("copy")).select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("id"), F.explode("fps").alias("fp"))
    shared = fps.groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("fp")
    live = ws.keep(fps.join(shared, "fp").groupBy("id").agg(F.collect_set("fp").alias("live")))
    ws.done(all_)

    def texts_of(ids: DataFrame) -> DataFrame:
        """The texts of the ids, which few of the others accompany to the join."""
        wanted = spark.sparkContext.broadcast(id_bitmap(ids.select("id")))  # fixed size

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(in_bitmap(wanted.value, np.asarray(b["doc_id"].fill_null(-1)))))

        # joined by a shuffle, so that this step and the next are not two Python workers in one task
        return docs.mapInArrow(run, docs.schema).withColumnRenamed("doc_id", "id").join(ids.hint("merge"), "id")

    def windows(batches):
        for b in slices(batches):
            w = Words(b["text"])
            if not len(w.hash):
                continue
            g, valid = w.grams(gram)
            h, whole = w.grams(window)
            text = w.text_of_word()
            lives = np.asarray(b["live"].flatten()).view(np.uint64)
            of = np.repeat(np.arange(b.num_rows), np.asarray(b["live"].value_lengths()))
            # a gram is live if its text lists it: compare by (text, gram)
            key = mix(g + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            hit = np.isin(key, mix(lives + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & valid
            near = np.zeros(len(g) + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(near, np.maximum(at - width + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            use = (np.cumsum(near)[:-1] > 0) & whole
            place = np.flatnonzero(use)
            order = np.lexsort((place, h[place], text[place]))  # of equal windows of a text, the first
            t, v = text[place][order], h[place][order]
            head = np.ones(len(t), bool)
            head[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
            stretch = (place[order][head] - w.first[t[head]]) // shard
            yield pa.RecordBatch.from_arrays([pa.array(signed(v[head])), pa.array(np.asarray(b["id"])[t[head]]), pa.array(stretch.astype(np.int32))], names=["w", "id", "shard"])

    held = ws.keep(texts_of(live).select("id", "text", "live").mapInArrow(windows, "w long, id long, shard int"))
    ws.done(live)
    owners = held.groupBy("w").agg(F.min(F.struct("id", "shard")).alias("o"), F.max("id").alias("hi")).filter("o.id < hi").select("w", F.col("o.id").alias("owner"), F.col("o.shard").alias("shard"))
    routes = ws.keep(held.select("w", "id").join(owners, "w").groupBy("id").agg(F.collect_list(F.struct("owner", "shard", "w")).alias("routes")))
    ws.done(held)

    def passages(batches):
        for b in slices(batches):
            w = Words(b["text"])
            h, whole = w.grams(window)
            for i, (doc, routes) in enumerate(zip(b["id"].to_pylist(), b["routes"], strict=True)):
                a, z = int(w.first[i]), int(w.first[i + 1])
                owner, part, key = (np.asarray(routes.values.field(c)) for c in ("owner", "shard", "w"))
                order = np.argsort(key.view(np.uint64))
                key = key.view(np.uint64)[order]
                shards, of_key = np.unique(np.stack([owner, part], 1)[order], axis=0, return_inverse=True)
                mine = h[a:z]
                place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                use = (key[place] == mine) & whole[a:z]
                at, of = np.flatnonzero(use), of_key.ravel()[place[use]]
                for k in np.unique(of).tolist():
                    p, (r, part_of) = at[of == k], shards[k].tolist()
                    cut = np.flatnonzero(np.diff(p) > 1) + 1
                    runs = [(int(q[0]), int(q[-1]) + window) for q in np.split(p, cut)]
                    words = np.concatenate([w.hash[a + x : a + y] for x, y in runs])
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([part_of], pa.int32()), pa.array([doc], pa.int64()), pa.array([[x for x, _ in runs]], pa.list_(pa.int32())), pa.array([[y - x for x, y in runs]], pa.list_(pa.int32())), pa.array([words.tobytes()], pa.binary())], names=["owner", "shard", "id", "start", "size", "words"])

    def joined(batches):
        """Rows of passages() in batches of some size."""
        rows, size = [], 0
        for b in passages(batches):
            rows.append(b)
            size += b.nbytes
            if len(rows) > 2000 or size > 4 << 20:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
                rows, size = [], 0
        if rows:
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()

    cut = ws.keep(texts_of(routes).select("id", "text", "routes").mapInArrow(joined, "owner long, shard int, id long, start array<int>, size array<int>, words binary"))
    ws.done(routes)
    replicas = cut.groupBy("owner", "shard").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("replicas"))
    dealt = cut.join(replicas, ["owner", "shard"]).withColumn("own", F.col("id") == F.col("owner"))
    dealt = dealt.withColumn("replica", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("replicas") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("replicas")).cast("int")))))

    def stream(batches):
        key = automaton = None
        for b in batches:
            found_id, found = [], []
            for *at_, own, doc, start, size, words in zip(*(b[c].to_pylist() for c in ("owner", "shard", "replica", "own", "id", "start", "size", "words")), strict=True):
                if key != at_:
                    key, automaton = at_, SuffixAutomaton()
                sequence = np.frombuffer(words, np.int64).tolist()
                at = 0
                for s, n in zip(start, size, strict=True):
                    if own:
                        automaton.add(sequence[at : at + n])
                    else:
                        for x, y in automaton.spans(sequence[at : at + n], window):
                            found_id.append(doc)
                            found.append({"a": s + x, "b": s + y})
                    at += n
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found_id, pa.int64()), pa.array(found, pa.struct([("a", pa.int32()), ("b", pa.int32())]))], names=["id", "span"])

    spans = dealt.repartition("owner", "shard", "replica").sortWithinPartitions("owner", "shard", "replica", F.col("own").desc(), "id").select("owner", "shard", "replica", "own", "id", "start", "size", "words").mapInArrow(stream, "id long, span struct<a:int,b:int>")
    spans = ws.keep(spans.groupBy("id").agg(F.collect_set("span").alias("spans")))
    ws.done(cut)
    return known, texts_of(spans)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", window: int = 50, gram: int = 16, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing was cut out) of every document."""
    ws = Workspace(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    known, spans = repeated_spans(ws, docs, window=window, gram=gram, shard=shard)

    def cut(batches):
        for b in slices(batches):
            out = []
            for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                words = text.encode().split()
                keep = np.ones(len(words), bool)
                for s in spans:
                    keep[s["a"] : s["b"]] = False
                kept = b" ".join(x for x, k in zip(words, keep.tolist(), strict=True) if k)
                out.append((int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(x) for x in zip(*out, strict=True))], names=["doc_id", "lost", "less", "kept_text"])

    changed = spans.select("id", "text", "spans").mapInArrow(cut, "doc_id long, lost long, less string, kept_text string").dropDuplicates(["doc_id"])
    nothing = hashlib.sha256(b"").hexdigest()
    out = known.join(changed, "doc_id", "left")
    return ws.result(out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("less", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    ))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
