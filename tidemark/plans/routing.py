"""Where elements and requests go: partitions of a dataset by key or at random, one set of them for each parallelism that live synopses ask for, and cells
of a grid for radius sketches. The routers are columns and joins, on tables as on streams; Spark's exchanges move the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import number
from tidemark.operators.similarity import radius_groups

RADIUS = 100  # the synopsis that makes a grid of its dataset. Fixed value.


def live_requests(requests: DataFrame) -> DataFrame:
    """The requests to add (1, 4, 5) that no later request to delete (2) has taken back; requests (as REQUEST, and at) are few."""
    adds = requests.filter("requestID IN (1, 4, 5)")
    gone = requests.filter("requestID = 2").groupBy(F.col("dataSetkey").alias("_d"), F.col("uid").alias("_u")).agg(F.max("at").alias("_at"))
    return adds.join(
        F.broadcast(gone), (F.col("dataSetkey") == F.col("_d")) & (F.col("uid") == F.col("_u")), "left"
    ).filter("_at IS NULL OR at > _at").drop("_d", "_u", "_at")


def route(dataset: Column, partitions: Column, how: Column, partition: Column) -> Column:
    """The name of one partition of a dataset."""
    return F.concat_ws("_", dataset, partitions.cast("string"), how, partition.cast("string"))


def routed_elements(elements: DataFrame, requests: DataFrame) -> DataFrame:
    """Elements (dataset, stream, and others) once for each parallelism that live requests of their dataset ask for, however many share it, with route: the
    stream's partition of so many (requests 1 and 5), or that of the element's whole content (request 4). Elements of other datasets go nowhere."""
    live = live_requests(requests).filter(F.col("synopsisID") != RADIUS)
    how = F.when(F.col("requestID") == 4, "RANDOM").otherwise("KEYED")
    groups = live.select(F.col("dataSetkey").alias("dataset"), F.greatest(F.coalesce("noOfP", F.lit(1)), F.lit(1)).alias("_n"), how.alias("_how")).distinct()
    content = number(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(elements.columns)]), text=True)
    partition = F.when(F.col("_how") == "KEYED", number(F.coalesce(F.col("stream").cast("string"), F.lit("")), text=True)).otherwise(content) % F.col("_n")
    return elements.join(F.broadcast(groups), "dataset").withColumn("route", route(F.col("dataset"), F.col("_n"), F.col("_how"), partition)).drop("_n", "_how")


def grid_elements(
    windows: DataFrame, requests: DataFrame, vector: str, length: int, groups: int = 10, side: float = 0.8, automatic: bool = False, seed: int = 100
) -> DataFrame:
    """(dataset, stream, cx, cy): windows (dataset, stream, a vector) of datasets with a live radius sketch as `groups` elements each, of the datasets
    dataset_0, dataset_1, ..., whose values are the cell of one group. automatic: every dataset has one, asked for or not."""
    own = windows if automatic else windows.join(
        F.broadcast(live_requests(requests).filter(F.col("synopsisID") == RADIUS).select(F.col("dataSetkey").alias("dataset")).distinct()), "dataset"
    )
    ids = own.select(F.struct("dataset", "stream").alias("id"), vector)
    cells = radius_groups(ids, "id", vector, length, groups, side, seed)
    return cells.select(F.concat_ws("_", "id.dataset", F.col("group").cast("string")).alias("dataset"), F.col("id.stream").alias("stream"), "cx", "cy")


def routed_requests(requests: DataFrame, groups: int = 10) -> DataFrame:
    """Each request once for each partition that it is for, with route: those of its parallelism, those of all its datasets for a join size (6), the
    grid's groups for a radius sketch. Requests whose number ends in 8 or 9 go nowhere; one without partitions keeps its dataset's name."""
    kept = requests.filter("requestID % 10 < 8")
    n = F.greatest(F.coalesce("noOfP", F.lit(1)), F.lit(1))
    datasets = F.when(F.col("requestID") % 10 == 6, F.split("dataSetkey", r"\s*,\s*")).otherwise(F.array("dataSetkey"))
    uids = F.when(F.col("requestID") % 10 == 6, F.transform(F.slice("param", 2, F.size(datasets)), lambda u: u.cast("int"))).otherwise(F.array("uid"))
    spread = kept.withColumn("_d", F.explode(F.arrays_zip(datasets.alias("dataset"), uids.alias("uid")))).withColumn("_n", n)
    how = F.when(F.col("requestID") % 10 == 4, "RANDOM").otherwise("KEYED")
    cell = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.concat_ws("_", F.col("_d.dataset"), g.cast("string")))
    parts = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda p: route(F.col("_d.dataset"), F.col("_n"), how, p))
    names = F.when(F.col("synopsisID") == RADIUS, cell).when(F.col("_n") > 1, parts).otherwise(F.array(F.col("_d.dataset")))
    return spread.withColumn("route", F.explode(names)).withColumn("uid", F.coalesce("_d.uid", "uid")).drop("_d", "_n")
