"""A quality classifier from weak labels.

Overlapping heuristic labellers vote reject or abstain on every document, in two families: junk (symbols, tables,
repetition, shouting, rhythm) and toxicity (insults, and words and word beginnings that a bounded sample of labelled
rows shows to be typical). For each family, expectation-maximisation over how often every pattern of votes occurs in all
documents estimates the labellers' accuracies without labels; the posterior of a document's pattern is its soft label.
The soft labels of a bounded sample train a hashed linear scorer by distributed gradient steps, and the scorer decides.

Bounds (documented parameters): `labelled_docs` rows for the lexicon, `train_docs` documents for the scorer. Votes,
patterns and scores cover all documents. Without a table of labels the two labellers that need it abstain.

A document without words is junk (score 1): there is nothing to keep. Null text counts as empty; rows that repeat a
doc_id, or lack one, are judged each by its text; a score that ties with the threshold rejects; texts of any length are
judged whole; labels without an id or a value are left out, and an id labelled twice is toxic if one of them says so; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace.llm.common import Workspace, dense_sum, slices, table
from glyphtrace.llm.kernels import _BYTE, _BYTES, Words, mix, ragged

#: Common insults, the seed of the toxic family.
INSULTS = ["idiot", "moron", "stupid", "pathetic", "disgusting", "worthless", "loser", "scum", "trash", "clown", "imbecile", "retard", "bastard", "asshole", "bitch", "whore", "slut", "dumbass", "jackass", "scumbag"]
BITS = 17
SIZE = 1 << BITS
JUNK, TOXIC = 6, 3

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _spans(w: Words, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix(_BYTES.slices(_BYTE[w.raw], start, end) + np.uint64(kind))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


class Batch:
    """Hashed features and word statistics of a batch of texts."""

    def __init__(self, column):
        w = Words(column, lower=True)
        raw = w.original
        self.words, self.texts, self.n = w, len(w.first) - 1, w.count
        start, end = w.start, w.end.copy()
        for _ in range(3):  # words without the punctuation at their ends
            end -= (end - start > 1) & _PUNCT[w.raw[end - 1]]
        self.text = w.text_of_word()
        self.exact = _spans(w, start, end, 1)
        self.whole = _bucket(self.exact)
        self.begin = _bucket(_spans(w, start, np.minimum(start + 6, end), 2))
        total = np.maximum(self.n, 1)

        def share(flags) -> np.ndarray:
            return np.bincount(self.text, flags, self.texts) / total

        first, last = raw[w.start], raw[w.end - 1]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw], dtype=np.int32)])
        upper = np.concatenate([[0], np.cumsum(_UPPER[raw], dtype=np.int32)])
        letters = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int32)])
        span = lambda c: c[w.end] - c[w.start]
        same = np.zeros(len(self.text), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (self.text[1:] == self.text[:-1])
        pairs = np.sort((self.text.astype(np.uint64) << np.uint64(44)) | (w.hash >> np.uint64(20)))
        head = np.ones(len(pairs), bool)
        head[1:] = pairs[1:] != pairs[:-1]
        distinct = np.bincount((pairs[head] >> np.uint64(44)).astype(np.int64), minlength=self.texts)
        lone = (w.end - w.start == 1) & _SYMBOL[first]
        ends = (last == 46) | (last == 63) | ((last == 33) & (span(np.concatenate([[0], np.cumsum(raw == 33, dtype=np.int32)])) == 1))
        self.stats = np.stack([
            share((span(symbols) >= 2) & ~lone),  # words with symbols
            share(lone),  # cells of tables
            share(same),  # words said again at once
            share((span(upper) * 2 > span(letters)) & (span(letters) >= 2)),  # shouted words
            distinct / total,
            share(ends),  # words that end a sentence
        ], 1)

    def features(self, bins: bool = True):
        """(text, feature, value) entries: hashed words, beginnings and bins of the statistics."""
        out = []
        for ids in (self.whole, self.begin):
            key, n = np.unique(self.text * SIZE + ids, return_counts=True)
            t = key // SIZE
            out.append((t, key % SIZE, n / np.sqrt(np.maximum(self.n[t], 1))))
        if bins:
            level = np.digitize(self.stats, [0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6])
            for k in range(self.stats.shape[1]):
                out.append((np.arange(self.texts), _bucket(mix((level[:, k] + 16 * (k + 1)).astype(np.uint64))), np.ones(self.texts)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _votes(b: Batch, lexicon: dict) -> np.ndarray:
    """1 reject or 0 abstain of each labeller on each text: a labeller looks for one flaw and has no opinion where it finds none."""

    s = b.stats.T
    junk = [
        s[0] > 0.15,
        s[1] > 0.08,
        s[2] > 0.15,
        s[3] > 0.4,
        (b.n >= 8) & (s[4] * np.sqrt(b.n) < 1.5),
        (b.n >= 60) & (s[5] < 0.004),
    ]
    count = lambda flags, of: np.bincount(b.text, flags[of], b.texts) if len(of) else np.zeros(b.texts)
    toxic = [np.bincount(b.text, np.isin(b.exact, lexicon["seed"]), b.texts) >= 1, np.zeros(b.texts, bool), np.zeros(b.texts, bool)]
    if lexicon["labelled"]:
        starts, usual = count(lexicon["begin"], b.begin), lexicon["usual"] * b.n
        toxic[1:] = [count(lexicon["words"], b.whole) >= 1, (starts >= 2) & (starts > usual + 2.33 * np.sqrt(usual) + 1)]
    return np.stack(junk + toxic, 1).astype(np.int64)


def learn_lexicon(labelled: DataFrame | None) -> dict:
    """Hashed words and beginnings that toxic rows of the labelled sample hold far more often than others."""
    seed = np.unique(Batch(pa.array(INSULTS)).exact)
    empty = {"seed": seed, "words": np.zeros(SIZE), "begin": np.zeros(SIZE), "usual": 0.0, "labelled": False}
    if labelled is None:
        return empty

    def run(batches):
        texts = 0
        out = np.zeros((2, 5, SIZE))  # by class: documents with the word, words, documents with the beginning, beginnings, words of those documents
        for part in slices(batches):
            b = Batch(part["text"])
            toxic = np.asarray(part["toxic"]).astype(np.int64)
            texts += toxic.sum()
            for k, ids in enumerate((b.whole, b.begin)):
                key, n = np.unique(b.text * SIZE + ids, return_counts=True)
                t = toxic[key // SIZE]
                for c in (0, 1):
                    out[c, 2 * k] += np.bincount(key[t == c] % SIZE, minlength=SIZE)
                    out[c, 2 * k + 1] += np.bincount(key[t == c] % SIZE, n[t == c], SIZE)
                    if k:
                        out[c, 4] += np.bincount(key[t == c] % SIZE, b.n[key[t == c] // SIZE], SIZE)
        return np.append(out.ravel(), texts)

    *sums, texts = dense_sum(labelled, run, 10 * SIZE + 1, np.float32, 1 << 14)
    clean, toxic = np.reshape(sums, (2, 5, SIZE))
    if not toxic[1].sum() or not clean[1].sum():
        return empty
    rate = lambda x, k: x[k] / max(x[k].sum(), 1)
    words = (toxic[0] >= 5) & (rate(toxic, 1) > 40 * (rate(clean, 1) + 0.5 / max(clean[1].sum(), 1))) & (clean[0] <= 0.02 * toxic[0])
    expected = rate(clean, 3) * toxic[3].sum()
    begin = (toxic[2] >= max(8, 0.04 * texts)) & (toxic[3] > 3 * expected) & (toxic[3] - expected > 8 * np.sqrt(expected + 1)) & (rate(toxic, 3) > 5e-5)
    return {"seed": seed, "words": words.astype(float), "begin": begin.astype(float), "usual": float(clean[3][begin].sum() / max(clean[4][begin].sum(), 1)), "labelled": True}


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, most_wrong: float = 0.002) -> np.ndarray:
    """The posterior of reject for each pattern of votes, labellers being independent given the class.

    most_wrong bounds how often a labeller is taken to fire on a clean document; without it, two labellers that often
    fire together would make up a class of their own and the others' votes would count as noise.
    """
    n, k = patterns.shape
    post = np.where((patterns == 1).any(1), 0.9, 0.05)
    for _ in range(rounds):
        prior = np.clip((counts * post).sum() / max(counts.sum(), 1), 1e-4, 0.5)
        ratio = np.full(n, np.log(prior / (1 - prior)))
        for j in range(k):
            hits = np.stack([(patterns[:, j] == v) for v in (0, 1)])
            one = (hits * counts * post).sum(1) + [1.0, 1.0]
            two = (hits * counts * (1 - post)).sum(1) + [1.0, 0.01]
            one, two = one / one.sum(), two / two.sum()
            wrong = min(two[1], most_wrong)
            two = np.array([1 - wrong, wrong])
            if one[1] < two[1]:  # a labeller may be useless, not inverted
                one = two
            ratio += (hits * (np.log(one) - np.log(two))[:, None]).sum(0)
        new = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return post


def _train(features: DataFrame, steps: int = 28) -> np.ndarray:
    """Weights of the hashed scorers for junk and for toxicity, each with its bias last, by full-batch adaptive gradient steps."""
    weights, seen = np.zeros((2, SIZE + 1)), np.full((2, SIZE + 1), 1e-8)
    for step in range(steps):
        shared = features.sparkSession.sparkContext.broadcast(weights)

        def gradient(batches, shared=shared):
            g, n = np.zeros((2, SIZE + 1)), 0
            for b in batches:
                if not b.num_rows:
                    continue
                rows = np.repeat(np.arange(b.num_rows), np.asarray(b["feature"].value_lengths()))
                f, v = np.asarray(b["feature"].flatten()), np.asarray(b["value"].flatten())
                n += b.num_rows
                for k, target in enumerate(("junk", "toxic")):
                    z = np.bincount(rows, shared.value[k][f] * v, b.num_rows) + shared.value[k][SIZE]
                    d = np.asarray(b[target]) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    g[k, :SIZE] += np.bincount(f, d[rows] * v, SIZE)
                    g[k, SIZE] += d.sum()
            return np.append(g.ravel(), n)

        total = dense_sum(features, gradient, 2 * (SIZE + 1) + 1, np.float32, 1 << 14)
        g = total[:-1].reshape(2, SIZE + 1) / max(total[-1], 1) - 1e-6 * weights
        seen += g * g
        weights += (1.0 if step else 0.5) / (1 + step / 8) * g / np.sqrt(seen)
        shared.unpersist()
    return weights


def fit(docs: DataFrame, labels: DataFrame | None = None, *, labelled_docs: int = 20000, train_docs: int = 20000):
    """A broadcast pair of weights (junk, toxic) of the hashed scorer."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    docs = docs.select("doc_id", "text")
    n = docs.count()
    labelled = None
    if labels is not None:
        known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        share = min(1.0, labelled_docs / max(known.count(), 1))
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
        labelled = ws.keep(docs.join(F.broadcast(known), "doc_id").select("text", "toxic")).coalesce(3)  # about labelled_docs rows on either side
    lexicon = spark.sparkContext.broadcast(learn_lexicon(labelled))
    share = min(1.0, train_docs / max(n, 1))
    picked = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) < int(share * (1 << 20))

    def vote(batches):
        for part in slices(batches):
            votes = _votes(Batch(part["text"]), lexicon.value)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(votes @ 2 ** np.arange(JUNK + TOXIC)), part["picked"]], names=["doc_id", "pattern", "picked"])

    voted = docs.withColumn("picked", picked).mapInArrow(vote, "doc_id long, pattern long, picked boolean").groupBy("pattern").count().collect()  # 2 ** 9 rows at most
    codes, counts = np.array([r[0] for r in voted], np.int64), np.array([r[1] for r in voted], float)
    votes = codes[:, None] // 2 ** np.arange(JUNK + TOXIC) % 2
    soft = {int(c): (float(a), float(b)) for c, a, b in zip(codes, expectation_maximisation(votes[:, :JUNK], counts), expectation_maximisation(votes[:, JUNK:], counts), strict=True)}

    def sample(batches):
        for part in slices(batches):
            b = Batch(part["text"])
            code = _votes(b, lexicon.value) @ 2 ** np.arange(JUNK + TOXIC)
            t, f, v = b.features()
            order = np.argsort(t, kind="stable")
            size = np.bincount(t, minlength=b.texts)
            labels = np.array([soft[int(c)] for c in code]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ragged(f[order].astype(np.int32), size), ragged(v[order].astype(np.float32), size), pa.array(labels[:, 0]), pa.array(labels[:, 1])], names=["feature", "value", "junk", "toxic"])

    features = ws.keep(docs.filter(picked).mapInArrow(sample, "feature array<int>, value array<float>, junk double, toxic double")).coalesce(3)  # a bounded sample, written by all tasks and read again by few
    weights = _train(features)
    ws.drop(*range(len(ws.paths)))
    return spark.sparkContext.broadcast(weights)


def _probabilities(b: Batch, weights) -> tuple[np.ndarray, np.ndarray]:
    t, f, v = b.features()
    junk, toxic = (1 / (1 + np.exp(-np.clip(np.bincount(t, w[f] * v, b.texts) + w[SIZE], -30, 30))) for w in weights)
    return np.where(b.n == 0, 1.0, junk), toxic


def classify(docs: DataFrame, labels: DataFrame | None = None, *, threshold: float = 0.5, **bounds) -> DataFrame:
    """doc_id, junk, toxic (the scorer's probabilities) and keep of every document."""
    weights = fit(docs, labels, **bounds)

    def score(batches):
        for part in slices(batches):
            junk, toxic = _probabilities(Batch(part["text"]), weights.value)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(junk), pa.array(toxic), pa.array((junk < threshold) & (toxic < threshold))], names=["doc_id", "junk", "toxic", "keep"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, junk double, toxic double, keep boolean")


def keep_documents(docs: DataFrame, labels: DataFrame | None = None, *, threshold: float = 0.5, **bounds) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps."""
    weights = fit(docs, labels, **bounds)

    def run(batches):
        for part in slices(batches):
            junk, toxic = _probabilities(Batch(part["text"]), weights.value)
            yield part.filter(pa.array((junk < threshold) & (toxic < threshold)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
