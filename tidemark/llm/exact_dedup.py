"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name: blocks are sorted within a bucket and named
by their place, so two different blocks never share a name (no hash decides equality). Adjacent names are then paired and the pairs
named in the same way, halving the length each round, until one name is left for each text. Texts are equal exactly when they have
the same number of blocks and the same last name.

Before any block is named, texts that no other text can equal are settled: a text's byte length and sixteen eight-byte probes spread
evenly over it form a first, sparse block, and a text alone with its sparse block already has its identity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, perhaps_in

BUCKETS = 1 << 20
PROBES = 16


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def named(items: DataFrame, of: list[str]) -> DataFrame:
    """The distinct values of the columns `of`, each with an integer name: its place in its bucket's sorted order, and the bucket."""
    w = Window.partitionBy("bucket").orderBy(*of)
    return (
        items.select(*of)
        .distinct()
        .withColumn("bucket", F.pmod(F.xxhash64(*of), F.lit(BUCKETS)))
        .withColumn("name", F.row_number().over(w).cast("long") * BUCKETS + F.col("bucket"))
        .drop("bucket")
    )


def name_array() -> Column:
    return F.transform(F.sort_array(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is empty text. Null ids: a null is larger than every id, and a group whose ids are all null keeps a null keep_id (kept is
    true). Repeated rows (same id, same text) count in group_size and carry the same kept flag. An empty table gives no rows. Columns
    other than the two named are not read, whatever they are called.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    whole = rows.withColumn("bytes", F.col("text").cast("binary")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    probe = F.concat(*[F.substring(F.col("bytes"), (F.col("n_bytes") * k / F.lit(PROBES)).cast("int") + 1, F.lit(8)) for k in range(PROBES)])
    light = cut(whole.select("doc_id", "n_bytes", probe.alias("probe"), F.sha2("bytes", 256).alias("text_sha256")))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_sha256")

    unsettled = cut(light.groupBy("n_bytes", "probe").agg(F.count("*").alias("alike")).filter("alike > 1").drop("alike"))  # a table of its own, so that Spark can split the join's hot keys
    open_rows = cut(light.join(unsettled, ["n_bytes", "probe"]).select("doc_id", "text_sha256").distinct())
    marked, perhaps = perhaps_in(whole.withColumn("text_sha256", F.sha2("bytes", 256)), open_rows, ["doc_id", "text_sha256"])
    texts = (
        marked.filter(perhaps).alias("t")
        .join(open_rows.hint("merge").alias("o"), F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("t.text_sha256") == F.col("o.text_sha256")))
        .select("t.doc_id", "t.text_sha256", "bytes", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / block_bytes)).cast("int").alias("n_blocks"))
    )
    blocks = texts.select(
        key.alias("row_key"), "n_blocks",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.substring(F.col("bytes"), k * block_bytes + 1, F.lit(block_bytes))
        )).alias("pos", "block"),
    )
    level = cut(blocks.join(named(blocks, ["block"]), "block").groupBy("row_key", "n_blocks").agg(name_array()))
    finished = [level.filter(F.size("names") == 1)]
    while level.filter(F.size("names") > 1).limit(1).count():
        pairs = level.filter(F.size("names") > 1).select(
            "row_key", "n_blocks",
            F.posexplode(F.transform(
                F.sequence(F.lit(0), ((F.size("names") - 1) / 2).cast("int")),
                lambda k: F.struct(F.get("names", 2 * k).alias("l"), F.coalesce(F.get("names", 2 * k + 1), F.lit(-1)).alias("r"))
            )).alias("pos", "pair"),
        ).select("row_key", "n_blocks", "pos", "pair.l", "pair.r")
        level = cut(pairs.join(named(pairs, ["l", "r"]), ["l", "r"]).groupBy("row_key", "n_blocks").agg(name_array()))
        finished.append(level.filter(F.size("names") == 1))
    identity = reduce(DataFrame.unionByName, finished).select("row_key", "n_blocks", F.get("names", F.lit(0)).alias("name"))

    members = cut(light.withColumn("row_key", key).join(identity, "row_key", "left").select("doc_id", "text_sha256", "n_blocks", "name"))
    in_group, alone = members.filter("name IS NOT NULL"), members.filter("name IS NULL")
    groups = cut(in_group.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return (
        in_group.join(groups, ["n_blocks", "name"]).select(*out)
        .unionByName(alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}).select(*out))
    )
