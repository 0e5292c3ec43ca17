"""From raw documents to packed training sequences: language, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it again as the next one's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, mixing, near_dup, packing
from tidemark.llm._spark import cut, forget, passing, perhaps_in


def name(c: str) -> Column:
    """A column's value as text that no null shares, for joins in which null equals null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def without(docs: DataFrame, dropped: DataFrame, on: list[str]) -> DataFrame:
    """The rows of docs whose `on` (never null) is not in dropped. Only rows that a bitmap takes for dropped ones are shuffled, not all texts."""
    dropped = cut(dropped.select(*on).distinct())
    marked, perhaps = perhaps_in(docs, dropped, on)
    return marked.filter(~perhaps).unionByName(marked.filter(perhaps).join(dropped, on, "left_anti")).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or without a likely language go."""
    model = language_id.train(docs, F.col("lang"), F.col("text"), key=F.col("doc_id"))
    found = language_id.identify_documents(docs, model)
    keyed = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("id", name("doc_id"))
    rejected = found.filter("NOT accepted").select("key", name("doc_id").alias("id"))
    return without(keyed, rejected, ["id", "key"]).select(*docs.columns)


def one_of_each(docs: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """The rows of docs that found (id, key, kept) keeps, one of each id and key. Rows without an id, and rows that share one, are told apart by key."""
    found = cut(found)
    keyed = docs.select(F.struct(*docs.columns).alias("d"), name("doc_id").alias("id"), key.alias("key"))
    rest = without(keyed, found.filter("NOT kept"), ["id", "key"])
    repeated = cut(found.filter("kept").groupBy("id", "key").count().filter("count > 1").select("id", "key"))
    if repeated.limit(1).count():
        again = rest.join(repeated, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min_by("d", F.xxhash64("d")).alias("d"))
        rest = rest.join(repeated, ["id", "key"], "left_anti").select("d").unionByName(again.select("d"))
    return rest.select("d.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = exact_dedup.exact_dedup(docs).select(name("doc_id").alias("id"), F.col("text_sha256").alias("key"), "kept")
    return one_of_each(docs, F.sha2(exact_dedup.normalised(F.col("text")), 256), found)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    found = near_dup.jaccard_join(docs).select(name("doc_id").alias("id"), F.col("text_hash").alias("key"), "kept")
    return one_of_each(docs, F.xxhash64(F.coalesce("text", F.lit(""))), found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows of one id, source and size share their copies evenly."""
    on = ["id", "place", "size"]
    taken = mixing.mix_sources(docs).select(name("doc_id").alias("id"), name("source").alias("place"), "size", "copies")
    taken = cut(taken.groupBy(*on).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    keyed = docs.select(F.struct(*docs.columns).alias("d"), name("doc_id").alias("id"), name("source").alias("place"), mixing.word_count(F.col("text")).alias("size"))
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(F.xxhash64("d.text")))
    upto = lambda k: F.floor(F.col("copies") * k / F.col("rows"))
    own = keyed.withColumn("nth", nth).join(taken.hint("merge"), on).withColumn("own", (upto(F.col("nth")) - upto(F.col("nth") - 1)).cast("int"))
    return own.filter("own > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("own")))).select("d.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("jaccard_join", near), ("mix_sources", mix), ("pack", pack)]
ORACLE_SQL = None  # mixing and packing can't be expressed in SQL; tests/llm/test_pipeline.py compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with passing():  # a stage's own tables go when its result is written
            after = cut(stage(spark, docs, sf_dir), keep=True)
        if k:
            forget(docs)
        docs = after
    return docs
