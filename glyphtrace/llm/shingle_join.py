"""N-gram Jaccard join by vertical partitioning.

All shingles stand in one global order, rare ones first (by a counting sketch over all documents, then by hash). The
order is cut into fragments that hold equally many shingles; a document's set is thereby cut into segments. For a pair
of documents the overlap of each pair of segments is counted separately, and the counts are summed per pair.

Which pairs are counted: two sets with Jaccard >= t share one of their first n - ceil(t n) + 1 shingles (prefix filter),
have sizes within t, and parity bitmaps that differ in few enough bits; none of these loses a pair. As the result is
classes and not pairs, links come in two rounds. First every document is paired with one other of its prefix lists, by
most shared prefixes and mostly the document that is most typical of a list; the links found merge groups of copies.
Then the pairs of each list that are still in different classes are counted. Documents with equal sets are one document
throughout. So a group of many near copies costs about a pair per member and not their square.

Documents without words have an empty set and stand alone; with fewer words than a shingle has, the whole sequence is
the one shingle. Null texts are empty. A doc_id
stands for one text; rows that repeat one are alike and get alike results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace.llm.common import Workspace, apart, components, dense_sum, give_back, id_bitmap, in_bitmap, numbered, slices, table
from glyphtrace.llm.kernels import Words, mix, ragged, signed

SKETCH_BITS = 20
HASH_BITS = 58
PARITY_WORDS = 16
#: Longer sets have a second bitmap.
WIDE_FROM, WIDE_WORDS = 700, 128
#: Rows of a prefix list that one task compares with as many others; longer lists meet block by block.
LIST_BLOCK = 2048


def _shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, repeats included."""
    grams, valid = w.grams(n)
    text = w.text_of_word()
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    return np.concatenate([text[valid], short]), np.concatenate([grams[valid], w.whole()[short]])


def _ranks(w: Words, n: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, rank) of the distinct shingles of each text in the global order."""
    text, h = _shingles(w, n)
    rank = (level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
    order = np.lexsort((rank, text))
    text, rank = text[order], rank[order]
    head = np.ones(len(text), bool)
    head[1:] = (text[1:] != text[:-1]) | (rank[1:] != rank[:-1])
    return text[head], rank[head]


def _sketch(docs: DataFrame, n: int, lower: bool) -> np.ndarray:
    def run(batches):
        out = np.zeros(1 << SKETCH_BITS)
        for b in slices(batches):
            _, h = _shingles(Words(b["text"], lower), n)
            out += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(out))
        return out

    return dense_sum(docs, run, 1 << SKETCH_BITS)


def _whole_lists(batches, names: tuple[str, ...], most: int, ranged: bool = False):
    """(columns of sorted rows, whether their first list began before them, whether their last one goes on after them).

    Rows of equal first column stay together up to `most` of them. ranged: the first and last list of the task may go on in others.
    """

    def columns(b):
        return [np.asarray(b[c].flatten()).reshape(-1, PARITY_WORDS) if c == "parity" else np.asarray(b[c]) for c in names]

    held, waiting, begun = None, [], ranged
    batches = iter(batches)
    while True:
        b = next(batches, None)
        if b is not None and b.num_rows:
            waiting.append(columns(b))
        if not waiting or (b is not None and sum(len(w[0]) for w in waiting) < min(most, 40_000)):
            if b is None:
                break
            continue
        held = [np.concatenate(x) for x in zip(*([held] if held else []), *waiting, strict=True)]
        waiting = []
        cut = int(np.searchsorted(held[0], held[0][-1], side="left"))
        if long := len(held[0]) - cut > most:
            cut = len(held[0])
        if cut:
            yield [x[:cut] for x in held], begun, long
            begun = long
            held = [x[cut:] for x in held] if cut < len(held[0]) else None
    if held is not None and len(held[0]):
        yield held, begun, ranged
    held = None
    give_back()


def _pivots(counts: np.ndarray, level: np.ndarray, fragments: int) -> np.ndarray:
    """Ranks that cut the global order into fragments of equal weight."""
    mass = np.bincount(level, counts, 32)
    ends = np.cumsum(mass)
    out = []
    for k in range(1, fragments):
        want = ends[-1] * k / fragments
        c = int(np.searchsorted(ends, want))
        inside = 1 - (ends[c] - want) / mass[c] if mass[c] else 0.0
        out.append((c << HASH_BITS) + int(min(max(inside, 0.0), 0.999999) * (1 << HASH_BITS)))
    return np.array(out, np.uint64)


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", shingle: int = 4, percent: int = 85, lower: bool = True, fragments: int = 4, most: int = 1 << 18, block: int = LIST_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by 100 * intersection >= percent * union, and what links reach.

    most: rows of a prefix list that a task holds at once; block: rows of one that it compares with as many others.
    Both bound memory and leave the result as it is.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), "text")
    counts = _sketch(docs.select("text"), shingle, lower)
    level = np.minimum(np.log2(counts + 1).astype(np.int64), 31)
    order = spark.sparkContext.broadcast((level.astype(np.uint8), _pivots(counts, level, fragments)))  # 1 MB

    def describe(batches):
        level, _ = order.value
        for b in slices(batches):
            w = Words(b["text"], lower)
            texts = len(w.first) - 1
            text, rank = _ranks(w, shingle, level)
            n = np.bincount(text, minlength=texts)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            place = np.arange(len(text)) - first[text]
            key = []
            for salt in (1, 2):
                sums = np.concatenate([[0], np.cumsum(mix(rank + np.uint64(salt)))]).astype(np.uint64)
                key.append(sums[first + n] - sums[first])
            bits = (np.bincount(text * (64 * PARITY_WORDS) + (mix(rank) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=texts * 64 * PARITY_WORDS) & 1).astype(np.uint8)
            parity = np.packbits(bits.reshape(texts, -1), axis=1).view(np.int64).ravel()
            long = np.flatnonzero(n > WIDE_FROM)  # more bits for long texts, whose shingles would fill the others
            order_ = np.cumsum(n > WIDE_FROM) - 1
            of_long = (n > WIDE_FROM)[text]
            more = (np.bincount(order_[text[of_long]] * (64 * WIDE_WORDS) + (mix(rank[of_long] ^ np.uint64(77)) % np.uint64(64 * WIDE_WORDS)).astype(np.int64), minlength=len(long) * 64 * WIDE_WORDS) & 1).astype(np.uint8)
            wide = ragged(np.packbits(more.reshape(len(long), 64 * WIDE_WORDS), axis=1).view(np.int64).ravel(), np.where(n > WIDE_FROM, WIDE_WORDS, 0))
            length = n - -(-percent * n // 100) + (n > 0)
            typical = np.bincount(text, (rank >> np.uint64(HASH_BITS)).astype(float), texts) / np.maximum(n, 1)
            front = place < length[text]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(signed(key[0])), pa.array(signed(key[1])), pa.array(typical.astype(np.float32)), ragged(parity, np.full(texts, PARITY_WORDS)), wide, ragged(signed(rank[front]), length)], names=["doc_id", "n", "k1", "k2", "typical", "parity", "wide", "prefix"])

    sets = ws.keep(docs.mapInArrow(describe, "doc_id long, n long, k1 long, k2 long, typical float, parity array<long>, wide array<long>, prefix array<long>"))
    reps = ws.keep(sets.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id")))
    # documents that repeat an earlier set go; most are told from the others by a bitmap, so that few wide rows are shuffled
    copies = ws.keep(sets.filter("n > 0").select("doc_id", "n", "k1", "k2").join(reps, ["n", "k1", "k2"]).filter("doc_id <> id").select(F.col("doc_id").alias("id")))
    wide_rows = sets.filter("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "n", "typical", "parity", "wide", "prefix")
    sure, asked = apart(wide_rows, copies)
    classes = ws.keep(sure.unionAll(asked.join(copies, "id", "left_anti")))

    # prefix lists in order of size: a row stays if a neighbour's size is within the similarity, as only then a pair can link;
    # tasks take ranges, so that a long list is dealt over several: rows beside a cut stay, as their neighbour is not seen
    def lists(batches):
        for (t, i, n, p, typical), begun, goes_on in _whole_lists(batches, ("token", "id", "n", "pos", "typical"), most, ranged=True):
            def fits(x, y):
                return np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent

            next_ = np.arange(len(t) - 1)
            beside = (t[1:] == t[:-1]) & fits(next_, next_ + 1)
            alone = np.ones(len(t), bool)  # lists of two: what they share from this shingle on must suffice, too
            alone[1:] = t[1:] != t[:-1]
            size = np.diff(np.append(np.flatnonzero(alone), len(t)))
            head = np.flatnonzero(alone)
            part = np.zeros(len(head), bool)
            part[0], part[-1] = part[0] or begun, part[-1] or goes_on
            two = head[(size == 2) & ~part]
            reach = np.minimum(p[two], p[two + 1]) + np.minimum(n[two] - p[two], n[two + 1] - p[two + 1])
            beside[two] &= reach * (100 + percent) >= (n[two] + n[two + 1]) * percent
            keep = np.zeros(len(t), bool)
            keep[:-1] |= beside
            keep[1:] |= beside
            keep[0], keep[-1] = keep[0] or begun, keep[-1] or goes_on
            if not keep.any():
                continue
            part = np.repeat(part, size)
            t, i, n, p, typical, part = (x[keep] for x in (t, i, n, p, typical, part))
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(t))))
            order = np.lexsort((i, -typical, of))
            hub, best = i[order][head][of], typical[order][head][of]
            before = np.concatenate([[0], i[:-1]])
            before[head] = i[head]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t, i, n, p, hub, before, best, part)], names=["token", "id", "n", "pos", "hub", "before", "best", "part"])

    spread = classes.select("id", "n", "typical", F.posexplode("prefix").alias("pos", "token"))
    spread = spread.repartitionByRange("token", "n", "id").sortWithinPartitions("token", "n", "id").select("token", "id", "n", "pos", "typical")
    shared = ws.keep(spread.mapInArrow(lists, "token long, id long, n long, pos int, hub long, before long, best float, part boolean"))

    parity = classes.select("id", "n", "parity", "wide")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that link: bitmap bound, then overlaps by fragment."""
        x = pairs.join(parity.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"), F.col("wide").alias("wa")), "a").join(parity.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"), F.col("wide").alias("wb")), "b")
        bits = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
        differ = F.when((F.size("wa") > 0) & (F.size("wb") > 0), bits("wa", "wb")).otherwise(bits("pa", "pb"))
        close = ws.keep(x.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))).select("a", "b", "na", "nb"))
        wanted = spark.sparkContext.broadcast(id_bitmap(close.select(F.col("a").alias("id")).union(close.select("b")).distinct()))  # fixed size

        def segments(batches):
            level, pivots = order.value
            for b in slices(b.filter(pa.array(in_bitmap(wanted.value, np.asarray(b["doc_id"].fill_null(-1))))) for b in batches):
                text, rank = _ranks(Words(b["text"], lower), shingle, level)
                key, size = np.unique(text * fragments + np.searchsorted(pivots, rank, side="right"), return_counts=True)
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(key // fragments)), pa.array((key % fragments).astype(np.int32)), ragged(signed(rank), size)], names=["id", "fragment", "part"])

        cut = ws.keep(docs.filter("doc_id is not null").mapInArrow(segments, "id long, fragment int, part array<long>"))
        # both sides are dealt by document and fragment, so the segments are shuffled once
        some = close.withColumn("fragment", F.explode(F.array(*[F.lit(k) for k in range(fragments)])))
        one = some.join(cut.select(F.col("id").alias("a"), "fragment", F.col("part").alias("x")), ["a", "fragment"])
        two = one.join(cut.select(F.col("id").alias("b"), "fragment", F.col("part").alias("y")), ["b", "fragment"])
        overlap = two.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("x", "y")).alias("common"))
        overlap = overlap.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common")).groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        return ws.keep(overlap.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"))

    # a list that is dealt over tasks has one hub, too: the best of its parts. There are two such lists a task and one for
    # each `most` rows at most, so they are broadcast
    parts = shared.filter("part").groupBy("token").agg(F.max(F.struct("best", (-F.col("hub")).alias("low"))).alias("x")).select("token", (-F.col("x.low")).alias("other"))
    hubs = shared.filter("not part").select("id", F.col("hub").alias("other")).unionAll(shared.filter("part").select("token", "id").join(F.broadcast(parts), "token").select("id", "other"))
    votes = hubs.filter("id <> other").groupBy("id", "other").agg(F.count("*").alias("v")).unionAll(shared.filter("id <> before").groupBy("id", F.col("before").alias("other")).agg((F.count("*") - 0.5).alias("v")))
    best = votes.groupBy("id").agg(F.max(F.struct("v", "other"))["other"].alias("other"))
    first = linked(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    joined = ws.keep(components(ws, classes.select("id"), first))

    # lists whose documents are in several classes: all their pairs across classes that bitmaps and places allow. Rows of
    # a list's largest class do not meet each other, so a long list of one class and a few others costs one row each
    listed = ws.keep(shared.select("token", "id", "n", "pos").join(joined, "id"))
    several = listed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    mixed = ws.keep(listed.join(several, "token"))
    size = mixed.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("c"))
    size = size.select("token", F.col("top.component").alias("top"), F.ceil((F.col("c") - F.col("top.c")) / block).cast("int").alias("few"), F.ceil(F.col("top.c") / block).cast("int").alias("many"))
    mixed = mixed.join(size, "token").join(parity.select("id", "parity"), "id").withColumn("in_top", F.col("component") == F.col("top"))
    mixed = mixed.withColumn("block", F.when(F.col("in_top"), F.col("few") + F.pmod(F.xxhash64("id"), F.col("many"))).otherwise(F.pmod(F.xxhash64("id"), F.col("few"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(F.col("in_top"), 0).otherwise(F.col("many")))).alias("other")
    dealt = mixed.select("token", "id", "n", "pos", "component", "parity", "block", other)  # block i meets block j in a list of its own, i <= j
    dealt = dealt.select(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("list"), "id", "n", "pos", "component", "parity", (F.col("block") <= F.col("other")).cast("int").alias("left"), (F.col("block") >= F.col("other")).cast("int").alias("right"))

    def across(batches):
        for (t, i, n, p, comp, left, right, bits), *_ in _whole_lists(batches, ("list", "id", "n", "pos", "component", "left", "right", "parity"), 1 << 20):  # twice `block` rows a list
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.append(head, len(t)))
            out = []

            def test(x, y, i=i, n=n, p=p, comp=comp, left=left, right=right, bits=bits, out=out):
                total = n[x] + n[y]
                reach = np.minimum(p[x], p[y]) + np.minimum(n[x] - p[x], n[y] - p[y])
                ok = (comp[x] != comp[y]) & (left[x] & right[y] | left[y] & right[x]).astype(bool) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent) & (reach * (100 + percent) >= total * percent)
                x, y, total = x[ok], y[ok], total[ok]
                differ = np.bitwise_count(bits[x] ^ bits[y]).sum(1)
                ok = differ * (100 + percent) <= total * (100 - percent)
                if ok.any():
                    out.append(np.stack([np.minimum(i[x[ok]], i[y[ok]]), np.maximum(i[x[ok]], i[y[ok]])], 1))

            for k in np.unique(size).tolist():
                at = head[size == k]
                for d in range(1, k):  # pairs of rows at each distance, a band at a time: memory stays linear in the rows
                    x = (at[:, None] + np.arange(k - d)).ravel()
                    test(x, x + d)
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    pairs = dealt.repartition("list").sortWithinPartitions("list", "n", "id").mapInArrow(across, "a long, b long")
    second = linked(pairs.distinct())

    final = ws.keep(components(ws, classes.select("id"), first.unionAll(second)))
    of = reps.join(final, "id").select("n", "k1", "k2", "component")
    out = sets.select("doc_id", "n", "k1", "k2").join(of, ["n", "k1", "k2"], "left")
    return ws.result(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **join) -> DataFrame:
    """The rows of docs, all columns, of which each group of linked documents keeps the one with the smallest id.

    Where ids repeat or lack, every row is a document of its own, by its order in docs. Only rows that go are shuffled.
    """
    ws = Workspace(docs.sparkSession)
    rows = numbered(ws, docs, id_col)
    classes = jaccard_classes(rows.select("id", F.col(f"row_.`{text_col}`").alias("text")), id_col="id", **join)
    gone = ws.keep(classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")))
    as_is, asked = apart(rows, gone)
    ws.leave(rows, gone)
    return as_is.unionAll(asked.join(gone, "id", "left_anti").select(*rows.columns)).select("row_.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
