"""Removal of strings of bytes or words that occur more than once, by sampled names and the windows that they leave open.

The difference-cover scheme sorts sampled suffixes, replaces them by names and recurses on the names, so that any two
suffixes are compared through sampled ones. Here the sample is content-defined: the window of `window` bytes at each
position is represented by its smallest `gram`-byte hash (the leftmost one), so equal windows are represented at equal
places, and windows whose representative occurs once in the corpus leave at the first step. (Positions modulo three, as
in the original, cost several shuffles of a row per input byte; README has the figures.)

1. Representatives that occur twice, anywhere, are live.
2. The windows of a live representative form classes of `step` neighbouring starts. A class has two names: one for the
   bytes that all its windows share (the core), one for all bytes that they touch (the content). A core that occurs once
   has no repeated window; a content that occurs twice has only repeated ones.
3. What is left, classes with a common core and a content of their own, recurses to single windows: their names are
   counted, and a window whose name occurs twice is repeated.

A string's units are bytes or words (`unit`). What is cut is every place of a repeated string (keep="none") or every
place but the first, by id and position (keep="first").

Names are 64-bit hashes; all counting is grouped sums with partial aggregation, so a string that fills a third of the
corpus is no hot spot. Texts that are equal as a whole are one text with a count; if it is 2 or more and the text is
long enough, all of it goes. Matches never cross documents. Null text is empty. Rows that repeat a doc_id are copies
like any others, and each loses what it repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace.llm.common import Workspace, apart, id_bitmap, in_bitmap, numbered, slices, table
from glyphtrace.llm.kernels import _BYTE, _BYTES, _WORDS, Words, mix, ragged, signed, sliding_min, utf8

#: Units of a string: (window, gram, step) where the caller names none.
UNITS = {"bytes": (400, 64, 42), "words": (50, 12, 8)}
#: Rows of one class of equal texts are dealt over so many tasks.
SALTS = 16


class Units:
    """The units of every text of a column: a hash of each, where each text's begin, and names of their slices."""

    def __init__(self, column, unit: str):
        if unit == "words":
            self.words = Words(column)
            self.values, self.offsets, self.roller = self.words.hash, self.words.first, _WORDS
        else:
            raw, self.offsets = utf8(column)
            self.values, self.roller = _BYTE[raw], _BYTES

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.roller.slices(self.values, start, end))

    def bytes_of(self, text: int, x: int, y: int) -> tuple[int, int]:
        """The bytes, within its text, from unit x to before unit y of a text."""
        if self.roller is _BYTES:
            return x, y
        w, first = self.words, int(self.words.first[text])
        return int(w.start[first + x] - w.offsets[text]), int(w.end[first + y - 1] - w.offsets[text])


def _representatives(u: Units, window: int, gram: int):
    """(hashes of grams, for each position that starts a whole window the place of its leftmost smallest gram, or -1)."""
    offsets, total, width = u.offsets, len(u.values), window - gram + 1
    at = np.arange(total)
    g, valid = u.names(at, np.minimum(at + gram, total)), at + gram <= np.repeat(offsets[1:], np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    whole = at + window <= end
    if not whole.any():
        return g, np.full(total, -1, np.int64)
    # smallest hash first, then leftmost: a window's choice depends on its bytes alone
    place = np.uint64((1 << 31) - 1)
    key = np.where(valid, g & ~place, ~place) | at.astype(np.uint64)
    return g, np.where(whole, (sliding_min(key, width) & place).astype(np.int64), -1)


def _classes(u: Units, rep, use, window: int, step: int):
    """Classes of the window starts in `use`: (representative, number of the class, first start, last start, core name, content name, text)."""
    offsets, at = u.offsets, np.flatnonzero(use)
    p = rep[at]
    number = (p - at) // step
    head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (number[1:] != number[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(at)) - 1 if len(at) else head
    p, number, first, last = p[head], number[head], at[head], at[tail]
    text = np.searchsorted(offsets, first, side="right") - 1
    low, high = p - number * step - (step - 1), p - number * step + window
    from_, to = np.maximum(low, offsets[text]), np.minimum(high, offsets[text + 1])
    core = u.names(p - number * step, np.minimum(p - number * step + window - step + 1, to))
    content = mix(u.names(from_, to) + (from_ - low).astype(np.uint64) * np.uint64(1 << 20) + (high - to).astype(np.uint64))
    # starts of one class can be parted by a start that has another representative; a content only counts for equal starts
    content = mix(content + (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    return p, number, first, last, core, content, text


def repeated_starts(ws: Workspace, docs: DataFrame, *, unit: str = "bytes", window: int, gram: int, step: int, keep: str = "none") -> tuple[DataFrame, DataFrame]:
    """(known: id, doc_id, n units, sha of the text, all: whether all of it goes; texts with their runs of starts that go)."""
    spark = docs.sparkSession
    first_stays = keep == "first"

    def describe(batches):
        for b in slices(batches):
            u = Units(b["text"], unit)
            offsets, n = u.offsets, np.diff(u.offsets)
            g, rep = _representatives(u, window, gram)
            at = np.unique(rep[rep >= 0])
            # each hash once per text, with how often it stands there
            order = np.lexsort((g[at], np.searchsorted(offsets, at, side="right")))
            h, text = g[at][order], np.searchsorted(offsets, at[order], side="right") - 1
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
            times, size = np.diff(np.append(head, len(h))), np.bincount(text[head], minlength=len(n))
            raw, ends = utf8(b["text"])
            data = raw.tobytes()
            digest = [hashlib.sha256(data[x:y]).digest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], b["doc_id"], pa.array(n), pa.array(digest, pa.binary()), ragged(signed(h[head]), size), ragged(times.astype(np.int32), size)], names=["id", "doc_id", "n", "sha", "fps", "times"])

    all_ = ws.keep(docs.mapInArrow(describe, "id long, doc_id long, n long, sha binary, fps array<long>, times array<int>"))
    copies = all_.filter(F.col("n") >= window).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    # the rows of one class are dealt over tasks, so a text with very many copies is no hot key
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = all_.select("id", "doc_id", "n", "sha", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(copies, ["sha", "salt"], "left")
    second = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    known = ws.keep(salted.select("id", "doc_id", "n", F.lower(F.hex("sha")).alias("sha"), (second if first_stays else F.col("copies").isNotNull()).alias("all"), ((F.col("n") >= window) & ~second).alias("first")))
    # one text of each class, which counts as two if it has copies that go, too: then what it shares with others is repeated anyway
    members = known.filter("first").select("id", "all")
    fps = all_.select("id", "fps", "times").join(members, "id").select("id", "all", F.explode(F.arrays_zip("fps", "times")).alias("x")).select("id", "all", F.col("x.fps").alias("fp"), F.col("x.times").alias("times"))
    twice = fps.groupBy("fp").agg(F.sum("times").alias("c")).filter("c > 1").select("fp")
    live = ws.keep(fps.join(twice, "fp").groupBy("id", "all").agg(F.collect_list("fp").alias("live")))
    ws.done(all_)

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = spark.sparkContext.broadcast(id_bitmap(ids.select("id")))  # bounded, see id_bitmap

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(in_bitmap(wanted.value, np.asarray(b["id"]))))

        # joined by a shuffle, so that this step and the next are not two Python workers in one task
        return docs.mapInArrow(run, docs.schema).join(ids.hint("merge"), "id")

    def classes_of(b):
        u = Units(b["text"], unit)
        g, rep = _representatives(u, window, gram)
        at = np.unique(rep[rep >= 0])
        text = np.searchsorted(u.offsets, at, side="right") - 1
        of = np.repeat(np.arange(b.num_rows), np.asarray(b["live"].value_lengths()))
        key = lambda h, t: mix(h + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        alive = np.zeros(len(u.values) + 1, bool)
        alive[at[np.isin(key(g[at], text), key(np.asarray(b["live"].flatten()).view(np.uint64), of))]] = True
        return u, _classes(u, rep, (rep >= 0) & alive[rep], window, step)

    def name(batches):
        for b in slices(batches):
            u, (p, number, first, last, core, content, text) = classes_of(b)
            base = u.offsets[text]
            ids, whole = np.asarray(b["id"])[text], np.asarray(b["all"].cast(pa.int8()))[text]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array(signed(core)), pa.array(signed(content)), pa.array(whole)], names=["id", "a", "b", "core", "content", "all"])

    classes = ws.keep(texts_of(live).select("id", "text", "live", "all").mapInArrow(name, "id long, a int, b int, core long, content long, all tinyint"))
    ws.done(live)
    contents = classes.groupBy("core", "content").agg(F.sum(F.lit(1) + F.col("all")).alias("c"), F.min(F.struct("id", "a")).alias("first"))
    cores = contents.groupBy("core").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.min("c").alias("least"))
    # a content alone in a core with others is open; a repeated content beside an open one lends a copy of itself
    beside = F.col("kinds") > 1 if first_stays else (F.col("kinds") > 1) & (F.col("least") == 1)
    state = ws.keep(contents.join(cores.filter("total > 1"), "core").select("core", "content", F.col("c").alias("times"), "first", beside.alias("open")))
    told = classes.join(state, ["core", "content"])
    lent = "(id = first.id and a = first.a)"
    sure = ws.keep(told.filter("times > 1" + f" and not {lent}" * first_stays).select("id", "a", "b"))
    wanted = told.filter(f"open and (times = 1 or {lent})")
    listed = ws.keep(wanted.groupBy("id").agg(F.collect_list(F.struct("a", "b", F.when(F.col("times") > 1, 2).otherwise(1).alias("weight"))).alias("open")))
    ws.done(classes)

    def single(batches):
        for b in slices(batches):
            u = Units(b["text"], unit)
            of = np.repeat(np.arange(b.num_rows), np.asarray(b["open"].value_lengths()))
            o = b["open"].flatten()
            x, y, weight = (np.asarray(o.field(k)).astype(np.int64) for k in range(3))
            size = y - x + 1
            s = np.repeat(x - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            row = np.repeat(of, size)
            at = s + u.offsets[row]
            h = u.names(at, at + window)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.asarray(b["id"])[row]), pa.array(s.astype(np.int32)), pa.array(np.repeat(weight, size).astype(np.int32))], names=["w", "id", "a", "weight"])

    windows = ws.keep(texts_of(listed).select("id", "text", "open").mapInArrow(single, "w long, id long, a int, weight int"))
    again = windows.groupBy("w").agg(F.sum("weight").alias("c"), F.min(F.struct("id", "a")).alias("first")).filter("c > 1").select("w", "first")
    more = windows.join(again, "w").filter(f"not {lent}" if first_stays else "weight = 1").select("id", "a", F.col("a").alias("b"))
    runs = ws.keep(sure.unionAll(more).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("runs")))
    for spent in (state, sure, listed, windows):
        ws.done(spent)
    return known, texts_of(runs)


def covered(runs: list, window: int) -> list[tuple[int, int]]:
    """Maximal spans of units that the windows of runs of starts cover."""
    out: list[tuple[int, int]] = []
    for r in sorted((r["a"], r["b"]) for r in runs):
        a, b = r[0], r[1] + window
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(ws: Workspace, rows: DataFrame, *, id_col: str, text_col: str, unit: str, window: int | None = None, gram: int | None = None, step: int | None = None, keep: str) -> tuple[DataFrame, DataFrame]:
    """(known as in repeated_starts; id, lost, spans, less, kept of the texts out of which something is cut)."""
    window, gram, step = (x or usual for x, usual in zip((window, gram, step), UNITS[unit], strict=True))
    docs = rows.select("id", F.col(f"row_.`{id_col}`").cast("long").alias("doc_id"), F.col(f"row_.`{text_col}`").alias("text"))
    known, texts = repeated_starts(ws, docs, unit=unit, window=window, gram=gram, step=step, keep=keep)

    def cut(batches):
        for b in slices(batches):
            out, u = [], Units(b["text"], unit)
            for k, (text, runs) in enumerate(zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True)):
                data, spans, at, kept = text.encode(), covered(runs, window), 0, []
                for x, y in spans:
                    from_, to = u.bytes_of(k, x, y)
                    kept.append(data[at:from_])
                    at = to
                kept = b"".join([*kept, data[at:]])
                out.append((sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(x) for x in zip(*out, strict=True))], names=["id", "lost", "spans", "less", "kept"])

    return known, texts.select("id", "text", "runs").mapInArrow(cut, "id long, lost long, spans long, less string, kept binary")


def _told(known: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of remove_repeated, and id."""
    nothing = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    return known.join(changed, "id", "left").select(
        "id", "doc_id", F.col("n").alias("n_units"),
        F.when(F.col("all"), F.col("n")).otherwise(F.coalesce("lost", zero)).alias("n_removed"),
        F.when(F.col("all"), F.lit(1)).otherwise(F.coalesce("spans", zero)).cast("long").alias("n_spans"),
        F.when(F.col("all"), F.lit(nothing)).otherwise(F.coalesce("less", "sha")).alias("kept_sha256"),
        F.when(F.col("all"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", unit: str = "bytes", window: int | None = None, gram: int | None = None, step: int | None = None, keep: str = "none") -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256, kept (the bytes left, null where nothing was cut out) of every document.

    n_units and n_removed count bytes or words, as `unit` says. The bytes between words that stay are left as they are.
    """
    ws = Workspace(docs.sparkSession)
    rows = numbered(ws, docs.select(id_col, "text"), id_col)
    return ws.result(_told(*_runs(ws, rows, id_col=id_col, text_col="text", unit=unit, window=window, gram=gram, step=step, keep=keep)).drop("id"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "words", keep: str = "first") -> DataFrame:
    """The rows of docs, all columns, with repeated strings cut out of their texts; rows of which no unit is left go.

    Only rows that change are shuffled by their id. Rows without units, null or empty, stay as they are; where ids repeat
    or lack, rows go by their order in docs.
    """
    ws = Workspace(docs.sparkSession)
    rows = numbered(ws, docs, id_col)
    known, changed = _runs(ws, rows, id_col=id_col, text_col=text_col, unit=unit, keep=keep)
    lost = ws.keep(changed.join(known.select("id", "n"), "id").select("id", F.when(F.col("lost") < F.col("n"), F.col("kept")).alias("kept")).unionAll(known.filter("all").select("id", F.lit(None).cast("binary"))))
    as_is, asked = apart(rows, lost)
    found = asked.join(lost.withColumn("told", F.lit(True)), "id", "left").filter("told is null or kept is not null")
    text = F.when(F.col("told"), F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col(f"row_.`{text_col}`"))
    found = found.select(*[(text if c == text_col else F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])
    ws.leave(rows, lost)
    return as_is.select("row_.*").unionAll(found)


def remove_repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", window: int = 400, gram: int = 64) -> DataFrame:
    """remove_repeated by bytes, with their number as n_bytes."""
    return remove_repeated(docs, id_col=id_col, window=window, gram=gram).withColumnRenamed("n_units", "n_bytes")


def repeated_bytes_and_passages(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """remove_repeated_bytes without the kept bytes, and n_passage_words: words under a string of 50 words that also starts anywhere else.

    400 bytes hold about 65 words, so shorter repeated passages show only there; they are not cut.
    """
    ws = Workspace(docs.sparkSession)
    rows = numbered(ws, docs.select(id_col, "text"), id_col)
    cut = ws.keep(_told(*_runs(ws, rows, id_col=id_col, text_col="text", unit="bytes", keep="none")).drop("kept").withColumnRenamed("n_units", "n_bytes"))
    passages = _told(*_runs(ws, rows, id_col=id_col, text_col="text", unit="words", keep="none")).select("id", F.col("n_removed").alias("n_passage_words"))
    return ws.result(cut.join(passages, "id").drop("id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes_and_passages(table(spark, sf_dir, "documents"))
