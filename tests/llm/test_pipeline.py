from pyspark.sql import functions as F

import corpus_pipeline
from glyphtrace.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), *[c for c in docs.columns if c != "doc_id"]).select(*docs.columns)
    docs = docs.unionAll(odd).withColumns({"kept": F.lit(1), "id_": F.lit(2), "n_removed": F.lit("x")})
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert out.columns == docs.columns, name
        if name != "mixing":
            assert 0 < out.count() <= before
        docs, before = out, out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs.filter("doc_id is not null"), SF)
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_stages_of_odd_tables(spark):
    """An empty table stays empty; rows without ids or with the same one, nulls and equal texts are documents of their own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("doc_id < 0"), SF).count() == 0
    text = docs.filter("length(text) > 2000").orderBy("doc_id").first()["text"]
    other = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text), (1, text), (1, other), (None, text + " more"), (None, other), (None, None), (2, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema if f.name not in ("doc_id", "text")]).select(*docs.columns).coalesce(1)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, odd, SF).collect()
    assert sorted((r["text"] or "")[:20] for r in kept) == sorted(["", "", text[:20], other[:20]])
    cut = stages["repeated_text"](spark, odd, SF).collect()
    assert sorted(len((r["text"] or "").split()) for r in cut) == sorted([0, 0, 1, len(text.split()), 80])
    assert stages["mixing"](spark, odd, SF).columns == docs.columns
    assert {r["doc_id"] for r in stages["packing"](spark, odd, SF).collect()} == {None, 1, 2}


def test_passages_under_400_bytes_are_cut(spark):
    """A passage of 55 words stays in the document of the smallest id alone, though it has fewer than 400 bytes."""
    passage = " ".join(f"w{k:03d}" for k in range(55))
    rows = [(k, f"{' '.join(f'a{k}x{j}' for j in range(60))} {passage} {' '.join(f'b{k}x{j}' for j in range(60))}") for k in (5, 3, 9)]
    assert len(passage) < 400
    got = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["repeated_text"](spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")), SF).collect()}
    assert [passage in got[k]["text"] for k in (3, 5, 9)] == [True, False, False] and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert [len(got[k]["text"].split()) for k in (3, 5, 9)] == [175, 120, 120]


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
