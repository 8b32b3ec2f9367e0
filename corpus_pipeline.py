"""Corpus pipeline over `documents`: toxicity, near-duplicates, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All stages but the last return the
columns of `documents`; rows keep their ids, and a document that the mixture takes
several times is there as many times, in training order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import _store, decontaminate, mixture, near_dedup, queries, token_files, toxicity

#: Per cent of shared five-word shingles from which documents are near-duplicates.
SIMILARITY = 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns c0, c1, ..., so that no further column can clash; and the new names by the old."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    _store.ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=~queries.held_out())
    rows, name = _numbered(docs)
    scored = toxicity.score(rows, model, id_col=name["doc_id"], text_col=name["text"], keep=rows.columns)
    return scored.where("predicted = 0").select(*rows.columns).toDF(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that with the smallest id.

    Rows are told apart by id and text: of repeated rows one stays, and different texts
    under one id are judged each by itself.  Rows with a null id all stay.
    """
    _store.ship(spark)
    rows, name = _numbered(docs)
    own, text = F.col(name["doc_id"]), name["text"]
    keyed = rows.withColumn("key", F.when(own.isNotNull(), F.struct(own.alias("id"), F.xxhash64(text).alias("hash"))))
    found = near_dedup.near_duplicates(keyed, similarity=SIMILARITY, id_col="key", text_col=text)
    gone = found.where("NOT kept").select("key").distinct().withColumn("stays", F.lit(False))
    gone = _store.materialise(gone, "gone")
    again = keyed.where("key IS NOT NULL").groupBy("key").count().where("count > 1").select("key").join(gone, "key", "left_anti").withColumn("stays", F.lit(True))
    again = _store.materialise(again, "again")
    # one look-up decides; the texts are shuffled once at most
    decided = _store.materialise(gone.union(again).withColumnRenamed("key", "decided"), "decided")
    marked = keyed.join(_store.small(decided), F.col("key") == F.col("decided"), "left")
    once = marked.where("stays IS NULL").select(*rows.columns)
    if again.isEmpty():
        return once.toDF(*docs.columns)
    several = marked.where("stays").groupBy("key").agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
    return once.unionByName(several).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    _store.ship(spark)
    rows, name = _numbered(docs)
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=name["doc_id"], text_col=name["text"], keep=rows.columns)
    return found.where("NOT contaminated").select(*rows.columns).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mixture takes it."""
    _store.ship(spark)
    return mixture.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in order of doc_id, read back: one row for each document of the mixture.

    ``place`` is the row's place in the mixture (part of the input and row in it), so the
    training order is kept beside the files; it is null where docs aren't read from files.
    """
    _store.ship(spark)
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        rows = docs.select("doc_id", "text", (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias("place"))
    except AnalysisException:
        rows = docs.select("doc_id", "text", F.lit(None).cast("long").alias("place"))
    # the place goes through the files with the id
    files = token_files.write(rows.select(F.struct("doc_id", "place").alias("doc"), "text"), queries.tokenizer_path(), id_col="doc")
    return token_files.read(files, id_col="doc").select("doc.doc_id", "start", "n_tokens", "ids_crc32", "doc.place")


STAGES = [("toxicity", toxic), ("near-duplicates", near_duplicate), ("benchmark", benchmark), ("mixture", mix), ("tokens", tokens)]

#: The stages need learned scores and a tokenizer, which SQL can't express; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _store.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
