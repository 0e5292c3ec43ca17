"""Sources and sinks of data points, requests and estimations: files, and Kafka where its connector is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.spec import DATAPOINT, REQUEST


def kafka(spark: SparkSession, brokers: str, topic: str, earliest: bool = False, stream: bool = True) -> DataFrame:
    """(key, value) as text from a topic, from its end or its beginning. Needs the spark-sql-kafka package."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    if earliest or not stream:
        reader = reader.option("startingOffsets", "earliest")
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def lines(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """(value) of text files, each line a message."""
    reader = spark.readStream if stream else spark.read
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def parsed(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Messages (value) as rows of a schema; those that are no JSON object give nulls in every field."""
    return messages.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")


def datapoints(messages: DataFrame, payload: T.StructType) -> DataFrame:
    """(dataset, stream, payload fields) of data messages, whose values are a JSON object in text or in place."""
    points = parsed(messages, DATAPOINT)
    return points.select(
        F.col("dataSetkey").alias("dataset"), F.col("streamID").alias("stream"), F.from_json("values", payload).alias("p")
    ).select("dataset", "stream", "p.*")


def requests(messages: DataFrame) -> DataFrame:
    return parsed(messages, REQUEST)


def csv_requests(messages: DataFrame) -> DataFrame:
    """Requests as comma-separated text with the parameters separated by semicolons."""
    f = F.split("value", ",")
    return messages.select(
        F.trim(f[0]).alias("dataSetkey"), F.trim(f[1]).cast("int").alias("requestID"), F.trim(f[2]).cast("int").alias("uid"), F.trim(f[3]).cast("int").alias("synopsisID"), F.trim(f[4]).alias("streamID"),
        F.transform(F.split(f[5], ";"), lambda x: F.trim(x)).alias("param"), F.trim(f[6]).cast("int").alias("noOfP"),
    )


def multiplied(df: DataFrame, times: int) -> DataFrame:
    """Each row so many times: a load generator."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def csv_estimations(messages: DataFrame) -> DataFrame:
    """Estimations as comma-separated text with the parameters separated by semicolons."""
    f = F.split("value", ",")
    return messages.select(
        F.trim(f[0]).alias("key"), F.trim(f[1]).alias("estimationkey"), F.trim(f[2]).alias("streamID"), F.trim(f[3]).cast("int").alias("uid"), F.trim(f[4]).cast("int").alias("requestID"),
        F.trim(f[5]).cast("int").alias("synopsisID"), F.trim(f[6]).alias("estimation"), F.transform(F.split(f[7], ";"), lambda x: F.trim(x)).alias("param"), F.trim(f[8]).cast("int").alias("noOfP"),
    )


def multiplexed(estimates: DataFrame) -> dict[str, DataFrame]:
    """Estimations by where they go: whole ones and partial ones that are yet to be merged (by noOfP), updates and others (by requestID)."""
    whole = F.coalesce("noOfP", F.lit(1)) == 1
    return {
        "single": estimates.filter(whole), "partial": estimates.filter(~whole), "updates": estimates.filter("requestID = 7"),
        "estimations": estimates.filter("requestID IS NULL OR requestID <> 7")
    }


def estimation_messages(estimates: DataFrame) -> DataFrame:
    """(key, value): the uid and the estimation as JSON, NULL_ESTIMATION where it is null. An update (request 7) goes out as the request that it holds, and
    what past windows found (synopsis 29) as comma-separated text."""
    said = F.coalesce(F.col("estimation").cast("string"), F.lit("NULL_ESTIMATION"))
    value = F.to_json(F.struct(*[said.alias(c) if c == "estimation" else F.col(c) for c in estimates.columns]))
    if "synopsisID" in estimates.columns:
        value = F.when(F.col("synopsisID") == 29, F.concat_ws(",", F.col("uid").cast("string"), "key", said)).otherwise(value)
    if "requestID" in estimates.columns:
        value = F.when(F.col("requestID") == 7, said).otherwise(value)
    return estimates.select(F.col("uid").cast("string").alias("key"), value.alias("value"))


def tuple_lines(df: DataFrame, *columns: str) -> DataFrame:
    """(value): the columns of each row as one line, arrays and numbers as text: (a,b,...)."""
    text = [F.concat(
        F.lit("["), F.array_join(F.transform(c, lambda v: v.cast("string")), ", "), F.lit("]")
    ) if df.schema[c].dataType.typeName() == "array" else F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return df.select(F.concat(F.lit("("), F.concat_ws(",", *text), F.lit(")")).alias("value"))


def kafka_sink(messages: DataFrame, brokers: str, topic: str, checkpoint: str | None = None):
    """Messages (key, value) to a topic: a batch at once, a stream by a query that is started and returned. Needs the spark-sql-kafka package."""
    options = {"kafka.bootstrap.servers": brokers, "topic": topic}
    if not messages.isStreaming:
        messages.write.format("kafka").options(**options).save()
        return None
    return messages.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()


def write_estimations(estimates: DataFrame, path: str, checkpoint: str | None = None):
    """A batch is appended to text files; a stream is started and returned, and continues from its checkpoint."""
    messages = estimation_messages(estimates).select("value")
    if not estimates.isStreaming:
        messages.write.mode("append").text(path)
        return None
    return messages.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).start()
