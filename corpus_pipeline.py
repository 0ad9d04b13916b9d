"""A corpus pipeline of five stages: quality, near duplicates, repeated text, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Rows that lack or repeat a doc_id are documents of their
own in every stage; among equal ones the first in the written docs stays. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace.llm.common import Workspace
from glyphtrace.llm.mixing import mix
from glyphtrace.llm.packing import pack
from glyphtrace.llm.quality import keep_documents
from glyphtrace.llm.shingle_join import without_near_copies
from glyphtrace.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five words, similarity 0.8), the document with the smallest id stays."""
    return without_near_copies(docs, shingle=5, percent=80)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every passage of 50 words or more that stands several times, all but the first place are cut out.

    First is the smallest doc_id, then the place in the text. Documents of which no word is left go; documents without
    words pass as they are. Rows that lack or repeat a doc_id keep apart by their order in the written docs.
    """
    out = without_repeats(docs, unit="words", keep="first")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_text", repeated_text), ("mixing", mixing), ("packing", packing)]

#: The stages are iterative and trained: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir))
    return ws.result(STAGES[-1][1](spark, docs, sf_dir))
