"""Mixing sources to target weights by entropy balancing.

Among all document rates with at most `cap` copies of a document, take those nearest to one copy each in Kullback-Leibler divergence
that give every source its target of words. The solution tilts exponentially in the constrained quantity:

    rate = min(cap, exp(lambda_source * size / scale_source)),

and lambda solves the convex dual, one token constraint for each source. Newton steps (kept inside a bracket, which the monotone
gradient allows) run as aggregations over the distinct sizes of each source. Rates are then rounded into whole copies by one running
sum of their fractional parts in the order of source and size, kept in integers so that partitioning cannot change it, and a
few passes move single documents up or down by one copy where that brings a source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, forget

UNIT = 1 << 20  # fractional parts of rates count in these


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Adds target to a table (skey, source_size) of sources: shares by weight in the order of skey, at most cap times the size, the excess reshared."""
    ranged = cut(sources.repartitionByRange("skey").withColumn("piece", F.spark_partition_id()))  # sources may be hosts: no window over all of them
    pieces = ranged.groupBy("piece").agg(F.count("*").alias("rows")).withColumn(
        "start", F.coalesce(F.sum("rows").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    place = F.col("start") + F.row_number().over(Window.partitionBy("piece").orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = cut(ranged.join(pieces.select("piece", "start"), "piece").select("skey", "source_size", weight.alias("weight")))
    level = -1.0
    while True:  # the level rises as sources reach their cap, until no further one does
        capped = cap * F.col("source_size") < F.col("weight") * level
        words, rest = t.agg(
            F.coalesce(F.sum(F.when(capped, (1 - cap) * F.col("source_size")).otherwise(F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
        ).first()
        after = words / rest if rest else 0.0
        if after <= level:
            break
        level = after
    return t.select("skey", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.col("weight") * max(level, 0.0)).alias("target"))


def balance(cells: DataFrame, sources: DataFrame, cap: int, rounds: int, tolerance: float) -> DataFrame:
    """(skey, lam, scale): Newton on the dual over cells (skey, size, n). A source whose target is its cap has lam infinite."""
    scale = cells.groupBy("skey").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = cut(
        sources.filter("source_size > 0").join(scale, "skey").select(
            "skey", "scale", "target",
            F.when(
                F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(float("inf"))
            ).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"),
            F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done"),
        )
    )
    for _ in range(rounds):
        z = F.col("size") / F.col("scale")
        words = F.col("n") * F.col("size")
        tilt = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        sums = cells.join(state.filter("NOT done AND lam < double('inf')").select("skey", "lam", "scale"), "skey").groupBy("skey").agg(
            F.sum(words * F.least(F.lit(float(cap)), tilt)).alias("f"), F.sum(F.when(tilt < cap, words * z * tilt).otherwise(0.0)).alias("slope")
        )
        step = state.join(sums, "skey", "left")
        gap = F.col("f") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        # a step that leaves the bracket is replaced: by its middle where both ends are known, else by one twice as far out
        middle = F.when((F.col("lo2") > -1e6) & (F.col("hi2") < 1e6), (F.col("lo2") + F.col("hi2")) / 2).otherwise(F.when(gap < 0, F.col("lam") + 1 + F.abs("lam")).otherwise(F.col("lam") - 1 - F.abs("lam")))
        over = F.col("f").isNull() | (F.abs(gap) <= tolerance * F.col("target"))
        before, state = state, cut(
            step.withColumns({"lo2": lo, "hi2": hi}).select(
                "skey", "scale", "target",
                F.when(over, F.col("lam")).when((newton > F.col("lo2")) & (newton < F.col("hi2")), newton).otherwise(middle).alias("lam"),
                F.when(over, F.col("lo")).otherwise(F.col("lo2")).alias("lo"), F.when(over, F.col("hi")).otherwise(F.col("hi2")).alias("hi"), over.alias("done"),
            )
        )
        forget(before)
        if not state.filter("NOT done").limit(1).count():
            break
    return state.select("skey", F.round("lam", 7).alias("lam"), "scale")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, rounds: int = 40, tolerance: float = 1e-6, repairs: int = 4,
) -> DataFrame:
    """One row per row of df: doc_id, size, source_size, target, taken, copies, rate, source.

    size counts words; null text has none. Sources in the order of code points, null last, weigh `weights`, repeating, and share all
    words; a target stops at cap times its source's words. taken = copies * size, copies a whole number from 0 to cap. Documents
    without words are copied once. Ties (one source and size) are ordered by id; repeated rows are rounded one by one, but a repair moves
    all rows of one id. An empty table gives no rows. Other columns are not read.
    """
    skey = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))
    rows = cut(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), skey.alias("skey"), word_count(F.col(text_col)).alias("size")))
    cells = cut(rows.filter("size > 0").groupBy("skey", "size").agg(F.count("*").alias("n")))
    sources = cut(source_targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, cap))
    dual = balance(cells, sources, cap, rounds, tolerance)

    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    order = ["skey", "size", F.col("doc_id").asc_nulls_first()]
    ranged = cut(
        rows.join(sources.join(dual, "skey", "left"), "skey").withColumn("rate", rate)
        .select("doc_id", "source", "skey", "size", "source_size", "target", "rate", F.floor("rate").cast("long").alias("base"))
        .withColumn("part", F.when(F.col("size") > 0, F.round((F.col("rate") - F.col("base")) * UNIT)).otherwise(0).cast("long"))
        .repartitionByRange(*order).withColumn("piece", F.spark_partition_id())
    )
    pieces = ranged.groupBy("piece").agg(F.sum("part").alias("total")).withColumn(
        "start", F.coalesce(F.sum("total").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    run = F.col("start") + F.sum("part").over(Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rounded = cut(
        ranged.join(pieces.select("piece", "start"), "piece").withColumn("run", run)
        .withColumn("copies", F.col("base") + F.floor(F.col("run") / UNIT).cast("long") - F.floor((F.col("run") - F.col("part")) / UNIT).cast("long"))
        .drop("piece", "start", "run", "base", "part")
    )
    moves, now = None, rounded
    for _ in range(repairs):  # moves are a few rows a source: a table of their own, joined to the rows, which are not written again
        short = cut(now.groupBy("skey").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short")).filter("abs(short) >= 1"))
        if not short.limit(1).count():
            break
        movable = F.when(F.col("short") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") < 2 * F.abs("short")) & (F.col("size") > 0)
        moved = (
            now.join(short, "skey").filter(movable).repartition("doc_id")  # so that a hot source's rows are spread before they are aggregated
            .groupBy("skey").agg(F.min_by(F.struct("doc_id", "short"), F.struct(F.abs(F.abs("short") - F.col("size")), "doc_id")).alias("m"))
            .select(F.col("m.doc_id").alias("doc_id"), "skey", F.signum("m.short").cast("long").alias("move"))
        )
        before, moves = moves, cut(moved if moves is None else moves.unionByName(moved).groupBy("doc_id", "skey").agg(F.sum("move").alias("move")))
        if before is not None:
            forget(before)
        now = rounded.join(moves, ["doc_id", "skey"], "left").withColumn(
            "copies", F.least(F.lit(cap), F.greatest(F.lit(0), F.col("copies") + F.coalesce("move", F.lit(0))))
        ).drop("move")
        if not moves.limit(1).count():
            break
    return now.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "source")
