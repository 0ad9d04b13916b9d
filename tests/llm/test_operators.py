"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphtrace.llm import common, language_model, licences, mixing, near_vectors, nearest, packing, quality, shingle_join, substring_dedup, suffix_dedup
from glyphtrace.llm.automaton import SuffixAutomaton
from glyphtrace.llm.kernels import Words, minimizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=60):
    """Prose with exact copies, near copies, a shared passage, a periodic text, nulls, empty and long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6))) for _ in range(400)]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, base = make(70), make(180)
    out = [make(r.choice([3, 40, 90, 200])) for _ in range(n)]
    for k in range(0, n, 6):
        out[k] = f"{make(30)} {passage}\n{make(20)}"
    near = base.split(" ")
    for k in range(1, n, 7):
        w = near.copy()
        w[r.randrange(len(w))] = "changed" + str(k)
        out[k] = " ".join(w)
    out[2] = out[9] = out[16] = base
    out[3], out[4], out[5], out[10] = None, "", " \t\n", "one two three"
    out[11], out[17], out[18] = "again and " * 300, make(4000), "ONE two three"
    out[19] = passage + " " + make(3) + " " + passage
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k, t, None if k % 11 == 0 else f"s{k % 3}", "en") for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """documents with columns whose names the operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("clash") for c in ("id", "n", "size", "rank", "row", "w", "kept", "source_", "copies")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def words(t):
    return WORD.findall(t or "")


def test_words_and_minimizers(rows):
    got = Words(pa.array([t for _, t, *_ in rows]))
    assert got.count.tolist() == [len(words(t)) for _, t, *_ in rows]
    seen = {}
    for h, w in zip(got.hash.tolist(), [w for _, t, *_ in rows for w in words(t)], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    g, valid = got.grams(4)
    _, whole = got.grams(10)
    at = set(minimizers(g, valid, 7, whole).tolist())
    for i in np.flatnonzero(whole).tolist():
        assert i + int(np.argmin(g[i : i + 7])) in at


@pytest.mark.parametrize("bounds", [{}, {"most": 2, "block": 3}])
def test_shingle_join(docs, rows, none, bounds):
    sets = {}
    for k, t, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    near = {k: {j for j in sets if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= 85 * len(sets[k] | sets[j])} | {k} for k in sets}
    want = {}
    for k in sorted(sets):
        if k not in want:
            reach, todo = set(), [k]
            while todo:
                x = todo.pop()
                if x not in reach:
                    reach.add(x)
                    todo += near[x]
            want |= dict.fromkeys(reach, k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.jaccard_classes(docs, **bounds).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in sets} and len(set(want.values())) < len(want) - 5
    assert shingle_join.jaccard_classes(none).count() == 0


@pytest.mark.parametrize("shard", [substring_dedup.SHARD, 37])
def test_substring_dedup(docs, rows, none, shard):
    first = {}
    for k, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, shard=shard).collect()}
    removed = 0
    for k, t, *_ in rows:
        w, keep = words(t), None
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < k:
                keep[i : i + 50] = [False] * 50
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()), k
        removed += keep.count(False)
    assert removed > 500 and len(got) == len(rows)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_automaton():
    r = random.Random(5)
    for _ in range(50):
        parts = [[r.randrange(3) for _ in range(r.randint(1, 40))] for _ in range(3)]
        query = [r.randrange(3) for _ in range(60)]
        a = SuffixAutomaton()
        for p in parts:
            a.add(p)
        known = {tuple(p[i : i + 5]) for p in parts for i in range(len(p) - 4)}
        covered = {j for i in range(len(query) - 4) if tuple(query[i : i + 5]) in known for j in range(i, i + 5)}
        assert {j for x, y in a.spans(query, 5) for j in range(x, y)} == covered


def _repeated(rows, window):
    count = Counter(b[i : i + window] for _, t, *_ in rows for b in [(t or "").encode()] for i in range(len(b) - window + 1))
    out = {}
    for k, t, *_ in rows:
        b, keep = (t or "").encode(), None
        keep = [True] * len(b)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                keep[i : i + window] = [False] * window
        spans = sum(not y and (i == 0 or keep[i - 1]) for i, y in enumerate(keep))
        out[k] = (len(b), keep.count(False), spans, hashlib.sha256(bytes(x for x, y in zip(b, keep, strict=True) if y)).hexdigest())
    return out


@pytest.mark.parametrize("window,gram", [(400, 64), (90, 16)])
def test_suffix_dedup(docs, rows, none, window, gram):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeated_bytes(docs, window=window, gram=gram).collect()}
    assert got == _repeated(rows, window) and sum(x[1] for x in got.values()) > 2000
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


@pytest.mark.parametrize("keep,gram,step", [("none", 12, 8), ("first", 12, 8), ("first", 40, 11)])
def test_suffix_dedup_of_words(docs, rows, none, keep, gram, step):
    places = defaultdict(list)
    for k, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            places[tuple(w[i : i + 50])].append((k, i))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(docs, unit="words", keep=keep, gram=gram, step=step).collect()}
    for k, t, *_ in rows:
        w = words(t)
        left = [True] * len(w)
        for i in range(len(w) - 49):
            at = places[tuple(w[i : i + 50])]
            if len(at) > 1 and (keep == "none" or min(at) != (k, i)):
                left[i : i + 50] = [False] * 50
        kept = got[k]["kept"]
        assert (got[k]["n_units"], got[k]["n_removed"]) == (len(w), left.count(False)), k
        assert words(bytes(kept).decode() if kept is not None else t) == [x for x, y in zip(w, left, strict=True) if y], k
    assert sum(r["n_removed"] for r in got.values()) > 500
    assert suffix_dedup.remove_repeated(none, unit="words", keep=keep).count() == 0


def test_suffix_dedup_counts_passages(docs, rows):
    count = Counter(tuple(w[i : i + 50]) for w in (words(t) for _, t, *_ in rows) for i in range(len(w) - 49))
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_bytes_and_passages(docs).collect()}
    want = _repeated(rows, 400)
    for k, t, *_ in rows:
        w, under = words(t), set()
        for i in range(len(w) - 49):
            if count[tuple(w[i : i + 50])] > 1:
                under |= set(range(i, i + 50))
        assert got[k]["n_passage_words"] == len(under) and (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == want[k]


def test_suffix_dedup_of_rows(docs, rows, none):
    """Texts are those that remove_repeated keeps; other columns stay, and rows without an id or with the same one are rows of their own."""
    told = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(docs, unit="words", keep="first").collect()}
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    want = {k: t if told[k]["kept"] is None else bytes(told[k]["kept"]).decode() for k, t, *_ in rows if not 0 < told[k]["n_units"] == told[k]["n_removed"]}
    assert {k: r["text"] for k, r in got.items()} == want and suffix_dedup.without_repeats(docs).columns == docs.columns
    assert len(want) < len(rows) and 3 in want and 4 in want
    odd = docs.filter("doc_id in (0, 5, 6)").withColumn("doc_id", F.lit(None).cast("long")).unionAll(docs.filter("doc_id in (12, 17)").withColumn("doc_id", F.lit(1).cast("long"))).coalesce(1)
    assert sorted(len(words(r["text"])) for r in suffix_dedup.without_repeats(odd).collect()) == [0, 50, 50, 120, 4000]
    assert suffix_dedup.without_repeats(none).count() == 0


def test_id_bitmap(spark):
    ids = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 40, 5000)
    held = common.id_bitmap(spark.createDataFrame([(int(x),) for x in ids], "id long").repartition(3))
    others = np.setdiff1d(np.arange(100_000), ids)
    assert common.in_bitmap(held, ids).all() and common.in_bitmap(held, others).mean() < 0.06
    assert not common.in_bitmap(common.id_bitmap(spark.createDataFrame([], "id long")), others).any()


def test_suffix_dedup_of_repeated_rows(docs):
    before = {k: docs.sparkSession.conf.get(k) for k in common.BATCH}
    twice = docs.filter("doc_id = 17").unionAll(docs.filter("doc_id = 17"))
    assert [r["n_removed"] == r["n_bytes"] for r in suffix_dedup.remove_repeated_bytes(twice).collect()] == [True, True]
    assert {k: docs.sparkSession.conf.get(k) for k in common.BATCH} == before


def test_mixing(docs, rows, none):
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    sizes, source = {k: len(words(t)) for k, t, *_ in rows}, {k: s for k, _, s, _ in rows}
    total = defaultdict(int)
    for k in sizes:
        total[source[k]] += sizes[k]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * total[s], mid * weight[s]) for s in order) < 1.5 * sum(total.values()) else (low, mid)
    taken = defaultdict(int)
    for k, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[k], total[source[k]]) and r["target"] == pytest.approx(min(2 * total[source[k]], low * weight[source[k]]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[k]] += r["taken"]
    for s in order:
        most = max(sizes[k] for k in sizes if source[k] == s)
        assert abs(taken[s] - min(2 * total[s], low * weight[s])) <= most / 2 + 1
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got.values()) and mixing.mix(docs).columns == docs.columns
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(5)).collect()} == {k: r["taken"] for k, r in got.items()}
    assert mixing.mix_sources(none).count() == 0


def test_packing(docs, rows, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    pieces = packing.pack(docs).collect()
    by = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p["piece"]):
        by[p["doc_id"]].append(p)
    for k, text, *_ in rows:
        ids, at = t.encode(text or "", add_special_tokens=False).ids + [2], 0
        for j, p in enumerate(by[k]):
            assert (p["piece"], p["start"]) == (j, at) and (p["length"] == 1024 or j == 0)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(sum(p["length"] for p in pieces) / 1024 * 1.05) + 1
    assert packing.pack(none).count() == 0


def test_packing_of_rows_without_ids_and_of_one_length(spark):
    """Repeated rows, rows without an id and pieces of one length or of a whole sequence are all placed, gapless and once."""
    rows = [(None, "a b c")] * 30 + [(1, "a b c")] * 30 + [(None, None), (2, "word " * 3000), (2, "word " * 3000), (3, "x " * 1023)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), capacity=64).collect()
    one = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).collect()
    piece = lambda r: tuple(r)[:5]
    assert sorted(map(piece, got), key=str) == sorted(map(piece, one), key=str) and len({r["sequence_id"] for r in got}) == len({r["sequence_id"] for r in one})
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in at.values():
        s.sort()
        assert sum(n for _, n in s) <= 64 and [x for x, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
    assert sum(r["doc_id"] is None for r in got) == 31


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_capacities(score):
    r = random.Random(2)
    histogram = Counter(r.randint(1, 100) for _ in range(500))
    plan = packing.best_fit(histogram, 100, 3, 6000.0, (1.0, 0.5, 0.5), score)
    held, placed = defaultdict(list), Counter()
    for length, rank, first, offset, n in plan.tolist():
        assert rank == placed[length]
        placed[length] += n
        for s in range(first, first + n):
            assert offset == sum(held[s])
            held[s].append(length)
    assert placed == histogram
    assert all(sum(s) <= 100 and len(s) <= 3 and (len(s) == 1 or sum(x * x for x in s) <= 6000) for s in held.values())


def _vectors(seed=4, n=300):
    g = np.random.Generator(np.random.PCG64(seed))
    v = g.normal(size=(n, 12))
    v[50:90] = v[49] + g.normal(size=(40, 12)) * 0.1
    v[100:110] = v[99]
    return v


@pytest.fixture(scope="module")
def vectors(spark):
    v = [(k, x.tolist(), "clash") for k, x in enumerate(_vectors())]
    odd = [(1000, None, ""), (1001, [0.0] * 12, ""), (1002, [float("nan")] + [1.0] * 11, ""), (1003, [None] + [1.0] * 11, ""), (1004, [], ""), (1005, [1.0, 2.0], "")]
    return spark.createDataFrame(v + odd, "vec_id long, embedding array<double>, id string")


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_nearest(vectors, block_rows):
    got = defaultdict(list)
    for r in nearest.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x, hits = _vectors(), 0
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(len(x)), d)).tolist() if k != q][:10]
        assert all(s == pytest.approx(d[k], abs=1e-12) for k, s in found) and len(found) == 10
        hits += len({k for k, _ in found} & set(want))
    assert hits >= 0.9 * 60
    assert nearest.nearest_neighbours(vectors.filter("vec_id < 0"), F.lit(True)).count() == 0


def test_nearest_of_repeated_rows(spark):
    x = _vectors(n=130)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    again = [(0, (x[0] + 9).tolist()), (3, (x[0] - 0.01).tolist()), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + rows + again, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.nearest_neighbours(df, F.col("vec_id") % 10 == 0, block_rows=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["rank"], r["score"]))
    hits = 0
    for q in range(0, 130, 10):
        asks = min([*[v for k, v in rows if k == q], *[v for k, v in again if k == q]])
        best = {}
        for k, v in rows + again:
            if k is not None and k != q:
                best[k] = min(best.get(k, math.inf), float(np.sqrt(((np.array(v) - asks) ** 2).sum())))
        want = sorted(best, key=lambda k: (best[k], k))[:10]
        assert [r for _, r, _ in got[q]] == list(range(1, 11)) and len({k for k, *_ in got[q]}) == 10
        assert all(s == pytest.approx(best[k], abs=1e-9) for k, _, s in got[q])
        hits += len({k for k, *_ in got[q]} & set(want))
    assert hits >= 0.9 * 130 and len(got) == 13


def test_nearest_of_equal_vectors(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0, 3.0] if k % 3 else [float(k), 0.0, 1.0]) for k in range(600)], "vec_id long, embedding array<double>")
    got = nearest.nearest_neighbours(df, F.col("vec_id") % 100 == 0, block_rows=16).collect()
    assert len(got) == 60 and all(r["score"] == 0 and r["vec_id"] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14][r["rank"] - 1] for r in got if r["query_id"] % 3)


@pytest.mark.parametrize("bounds", [{}, {"block": 5}, {"most_pivots": 12, "block": 20}])
def test_near_vectors(vectors, bounds):
    x = _vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    got = {r["vec_id"]: r for r in near_vectors.link_vectors(vectors, **bounds).collect()}
    assert len(got) == 306 and all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(1000, 1006))
    found, want = sum(got[k]["n_links"] for k in range(300)), int(near.sum()) - 300
    assert 0.9 * want <= found <= want and all(got[k]["n_links"] <= near[k].sum() - 1 for k in range(300))
    assert {got[k]["component_id"] for k in range(99, 110)} == {99} and got[99]["n_links"] >= 10
    assert near_vectors.link_vectors(vectors.filter("vec_id < 0")).count() == 0


def test_quality(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    make = lambda k: ". ".join(" ".join(r.choice(vocabulary) for _ in range(8)) for _ in range(k))
    good = [make(r.randint(3, 20)) for _ in range(150)]
    bad = [" | ".join(make(8).split()) for _ in range(15)] + [" ".join(w + "%%%" for w in make(6).split()) for _ in range(15)] + ["spam " * 200] * 5 + [make(6).upper().replace(" ", "!! ") for _ in range(10)]
    toxic = [make(4) + " you idiot moron " + make(3) + " stupid clown scum" for _ in range(20)]
    all_ = good + bad + toxic + [None, ""]
    df = spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string").withColumn("n", F.lit(1))
    got = {x["doc_id"]: x["keep"] for x in quality.classify(df).collect()}
    kept = [got[k] for k in range(len(all_))]
    assert sum(kept[:150]) >= 148 and sum(kept[150:]) <= 3 and not kept[-1] and not kept[-2]
    labels = spark.createDataFrame([(k, int(150 + len(bad) <= k < 150 + len(bad) + 20)) for k in range(0, len(all_), 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert quality.keep_documents(df, labels).columns == df.columns
    assert quality.classify(df.filter("doc_id < 0"), labels).count() == 0


def test_quality_of_odd_rows(spark):
    """Repeated rows, rows without ids and very long texts are judged each by its text, also where labels repeat or lack."""
    prose = ". ".join("one of many words that were said today by some" for _ in range(6))
    rows = [(1, prose), (1, prose), (None, prose), (2, "long text of words. " * 60_000), (3, "%%& $$# " * 90_000), (3, prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit("x"), "picked": F.lit(1), "keep": F.lit(2)})
    labels = spark.createDataFrame([(1, 0), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = [(r["doc_id"], r["junk"]) for r in quality.classify(df, labels).collect()]
    assert sorted(map(str, (k for k, _ in got))) == sorted(str(k) for k, _ in rows)
    assert len({x for k, x in got if k == 1 or k is None}) == 1 and len({x for k, x in got if k == 3}) == 2
    kept = quality.keep_documents(df, labels).collect()
    assert sum(r["text"] == prose for r in kept) in (0, 4)


def test_quality_of_held_out_labels(spark):
    """Toxic documents whose labels the classifier has not seen are found, clean ones of good quality stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    got = quality.classify(docs, labels.filter("doc_id % 2 = 0")).select("doc_id", "keep").join(labels, "doc_id").filter("doc_id % 2 = 1").collect()
    toxic, clean = [r["keep"] for r in got if r["toxic"]], [r["keep"] for r in got if not r["toxic"] and r["quality"]]
    assert len(toxic) >= 10 and len(clean) >= 50
    assert sum(toxic) <= 0.1 * len(toxic) and sum(clean) >= 0.97 * len(clean)


def test_em_finds_accuracies():
    g = np.random.Generator(np.random.PCG64(1))
    truth = g.random(20000) < 0.2
    votes = np.stack([np.where(truth, g.random(20000) < a, g.random(20000) < 0.001) for a in (0.9, 0.6, 0.3)], 1).astype(int)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality.expectation_maximisation(patterns, counts.astype(float))
    assert ((post[at.ravel()] > 0.5) == truth).mean() > 0.98


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n  http://www.apache.org/licenses/LICENSE-2.0\n"
    rows = [(1, "Some text.\nReleased under the MIT License."), (2, "x. Licensed under CC BY-NC 4.0. All rights reserved."), (3, None), (4, ""), (5, "this licence is odd"), (6, "plain"), (7, "Licensed under the Apache License, Version 2.0.\nand This work is licensed under the GNU General Public License, version 3."), (8, apache)]
    got = {r["doc_id"]: (r["licences"], r["verdict"]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", "recognised") and got[2] == ("All-rights-reserved,CC-BY-NC-4.0", "recognised") and got[3] == got[4] == got[6] == ("", "none") and got[5] == ("", "unknown")
    assert got[7][0] == "Apache-2.0" and got[8][1] == "recognised"


def test_language_model(docs, rows, none):
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    train = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    for hot in (1 << 19, 20):  # all words in the table, or most of them joined
        got = {r["doc_id"]: r for r in language_model.score(docs, train, hot_words=hot).collect()}
        tokens = {k: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for k, t, *_ in rows}
        count = Counter(w for k, ws in tokens.items() if not held(k) for w in ws)
        n, v = sum(count.values()), len(count)
        for k, ws in tokens.items():
            assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
            assert got[k]["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
            assert got[k]["score"] < 0
            assert got[k]["score"] >= got[k]["base_score"] - math.log10(2) - 1e-9
        assert sum(got[k]["score"] for k in tokens if held(k)) > sum(got[k]["base_score"] for k in tokens if held(k))
    assert language_model.score(none, none).count() == 0


def test_language_model_word_factor():
    """The steps end where the penalised likelihood is flat, and the words of a class keep a sum of one."""
    g = np.random.Generator(np.random.PCG64(3))
    share, group = g.dirichlet(np.ones(50)), np.repeat([0, 1], [20, 7])
    of = np.concatenate([g.choice(50, 20, False), g.choice(50, 7, False)])
    n = g.integers(2, 40, 27)
    mass = np.bincount(group, n)[group] + 30
    weight, total = language_model._step_pairs(share[of], n, mass, group)
    p = share[of] * np.exp(weight) / total[group]
    assert np.abs(n - mass * p - weight).max() < 1e-3
    for k in (0, 1):
        mine = group == k
        others = np.setdiff1d(np.arange(50), of[mine])
        assert p[mine].sum() + share[others].sum() / total[k] == pytest.approx(1)


def test_language_model_learns_word_order(spark):
    """Held-out texts in the order of words that training texts have score above the same words in another one."""
    r = random.Random(8)
    chain = {k: [r.randrange(60) for _ in range(2)] for k in range(60)}

    def walk(n):
        out = [r.randrange(60)]
        while len(out) < n:
            out.append(r.choice(chain[out[-1]]))
        return out

    text = lambda ws: " ".join(f"{chr(97 + k % 7)}{k}x" for k in ws)
    train = spark.createDataFrame([(k, text(walk(80))) for k in range(150)], "doc_id long, text string")
    held = [walk(80) for _ in range(20)]
    docs = spark.createDataFrame([(k, text(w)) for k, w in enumerate(held)] + [(100 + k, text(r.sample(w, len(w)))) for k, w in enumerate(held)], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in language_model.score(docs, train).collect()}
    none = {x["doc_id"]: x["score"] for x in language_model.score(docs, train, pairs=0).collect()}
    assert all(got[k] > got[100 + k] + 20 for k in range(20))
    assert sum(got[k] for k in range(20)) > 0.8 * sum(none[k] for k in range(20))


def test_language_model_on_prose(spark):
    """On held-out documents the model beats its base by far, and long or repeated texts and rows without ids are scored whole."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (10**6, "the word " * 50_000), (10**6, "the word " * 50_000)], docs.schema)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = language_model.score(docs.unionAll(odd), docs.filter(~held)).withColumn("held", F.coalesce(held, F.lit(False))).collect()
    base, model = (sum(r[c] for r in got if r["held"]) for c in ("base_score", "score"))
    assert model > 0.95 * base
    same = [(r["n_tokens"], r["score"]) for r in got if r["doc_id"] is None or r["doc_id"] == 10**6]
    assert sorted(n for n, _ in same) == [3, 3, 100_001, 100_001] and len({x for _, x in same}) == 2


def test_language_model_clusters_all_training_texts(spark, monkeypatch):
    class Seen(Exception):
        pass

    def clusters(train):
        raise Seen(train.count())

    monkeypatch.setattr(language_model, "ending_clusters", clusters)
    train = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    with pytest.raises(Seen, match="^3000$"):
        language_model.score(train.limit(1), train)


def test_language_model_features_do_not_collide():
    one, two = np.divmod(np.arange(language_model.CLASSES**2), language_model.CLASSES)
    f = language_model._features(one, two)
    assert [len(np.unique(x)) for x in f.T] == [1, language_model.CLASSES, language_model.CLASSES, language_model.CLASSES**2]
    assert len(np.unique(f)) == 1 + 2 * language_model.CLASSES + language_model.CLASSES**2


_NOTICES = {
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
}
_NOTICES |= {
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
}
_IDS = {
    "LGPL-2.1-or-later": "LGPL21-LATER",
    "LGPL-3.0-or-later": "LGPL3-LATER",
    "AGPL-3.0-or-later": "AGPL3-LATER",
    "ISC": "ISC-GRANT",
    "Unlicense": "UNLICENSE",
    "EPL-2.0": "EPL2-REF",
    "MPL-2.0": "MPL2-REF",
    "GPL-3.0-or-later": "GPL3-LATER>GPL-HOPE>GPL-SEE",
    "Apache-2.0": "APACHE2-GRANT>APACHE2-COMPLY>APACHE2-COPY>APACHE2-ASIS>APACHE2-SEE",
    "MIT": "MIT-GRANT>MIT-NOTICE>MIT-ASIS",
    "BSD-2-Clause": "BSD-GRANT>BSD-SOURCE>BSD-BINARY",
}


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_licences_of_canonical_notices(spark, sign):
    notices = {**_NOTICES, "GPL-2.0-or-later": _NOTICES["GPL-3.0-or-later"].replace("version 3", "version 2").replace("software:", "software;")}
    ids = {**_IDS, "GPL-2.0-or-later": _IDS["GPL-3.0-or-later"].replace("GPL3", "GPL2")}
    rows = [(name, "".join(sign + line + "\n" for line in ["Copyright 2024 A. Person", "", *t.splitlines()])) for name, t in notices.items()]
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"], r["verdict"]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {name: (ids[name], name, "recognised") for name in notices}


def test_licences_of_full_texts(spark):
    """Full texts are known by title and date, centred as they are printed."""
    titles = {
        "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n",
        "GPL-3.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
        "GPL-2.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
        "LGPL-3.0-only": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
        "LGPL-2.1-only": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n",
        "AGPL-3.0-only": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n",
    }
    rows = [(name, title + "\n Everyone is permitted to copy and distribute verbatim copies\n of this license document.\n") for name, title in titles.items()]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["licences"] for r in got} == {name: name for name in titles}


def test_licences_of_odd_rows(spark):
    """Repeated rows, rows without an id, clashing names, very long texts and an empty table."""
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "x. " * 50_000 + "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("s", "j", "hint", "q0", "licences", "verdict")})
    assert [(r["licences"], r["n_sentences"]) for r in licences.scan_licences(df).collect()] == [("MIT", 1), ("MIT", 1), ("MIT", 50_001)]
    assert licences.scan_licences(df.filter("doc_id < 0")).count() == 0


def test_licences_of_varied_ends(spark):
    grant, notice = " ".join(_NOTICES["MIT"].split()).split(": ")
    rows = [
        (1, f"{grant}, which bind all:\n{notice.replace('of the Software.', 'of the Software and its manuals.', 1)}"),
        (2, "Licensed under the GNU General Public License version 3 or later."),  # not version 3 only
        (3, "Licensed under the Apache License, Version 2.0\nThe License can be read online."),
        (4, "licensed under the Mit" + "\u4e2d" * 100_000 + " license" + ".-" * 50_000 + "x"),
    ]
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "", 3: "Apache-2.0", 4: ""}


def test_near_vectors_of_split_lists(spark):
    """Splitting lists and blocks changes no row; single and double precision agree."""
    x = _vectors(seed=9, n=200).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    one = near_vectors.link_vectors(df, threshold=0.6).orderBy("vec_id").collect()
    assert one == near_vectors.link_vectors(df, threshold=0.6, block=4).orderBy("vec_id").collect()
    assert one == near_vectors.link_vectors(df.withColumn("embedding", F.col("embedding").cast("array<double>")), threshold=0.6, block=30).orderBy("vec_id").collect()
    assert sum(r["n_links"] for r in one) > 100


def test_near_vectors_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [0.0, 1.0]), (4, [0.0, 1.0]), (5, None), (5, [0.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.link_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, None), (4, 0, 4, True), (5, 0, 5, True), (5, 0, 5, True), (None, 0, None, None)], key=str)


def test_near_vectors_with_negative_zeros(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [-0.0, 1.0]), (4, [1.0, -0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.link_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True)}


def test_mixing_draws_documents_without_ids(spark):
    df = spark.createDataFrame([(None, f"some words of text {k}", "a") for k in range(40)] + [(1, "more words " * 400, "b")], "doc_id long, text string, source string")
    got = [r for r in mixing.mix_sources(df, weights=(1.0, 20.0), share=0.1, most=1.0).collect() if r["doc_id"] is None]
    assert len(got) == 40 and 0 < got[0]["target"] < got[0]["source_size"]
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 3.5 and sum(r["taken"] for r in got) > 0


def test_mixing_plans_are_short(docs):
    """The driver holds every plan: the mix reads the targets and the last documents taken from one written table."""
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("HashJoin") + plan.count("MergeJoin") <= 1


def test_language_model_words_beyond_the_pairs_keep_their_part(spark):
    """Words of a class that are not among the pair words count in the fit, and the class's probabilities add up to one."""
    rows = ["a b"] * 40 + ["a c"] * 30 + ["a d"] * 20 + ["d b"] * 5
    words, clusters = Words(pa.array(rows), lower=True), (np.zeros(1, np.int64), np.zeros(1, np.int64))
    names, counts = np.unique(words.hash, return_counts=True)
    hot = language_model._Hot(names, counts, np.zeros(len(names), np.int64), int(counts.min()), 2)
    assert len(hot.often) == 2 and len(set(hot.classes)) == 1
    mass = np.bincount(hot.classes, hot.counts, language_model.CLASSES)
    ws = common.Workspace(spark)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    grams = language_model.gram_counts(ws, df, spark.sparkContext.broadcast(hot), clusters)
    pairs = language_model.fit_pairs(ws, grams.filter("key < 0").select((-1 - F.col("key")).alias("key"), "n"), hot, mass, 100)
    ws.restore()
    t = Words(pa.array(["a a", "a b", "a c", "a d"]), lower=True)
    place, known = hot.find(t.hash)
    at, before, key = language_model._pair_keys(t, hot, place, known)
    factor = np.zeros(len(t.hash))
    factor[at] = language_model._word_factor(pairs, hot, place, at, before, key)
    chance = (hot.counts / counts.sum())[place][1::2] * np.exp(factor[1::2])
    assert chance.sum() == pytest.approx(1, abs=1e-5)
    weight, total = language_model._step_pairs(np.array([45 / 190]), np.array([40.0]), np.array([90.0]), np.array([0]))
    assert chance[1] == pytest.approx(45 / 190 * np.exp(weight[0]) / total[0], rel=1e-4)
