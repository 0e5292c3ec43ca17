"""What a synopsis is asked to be, and the messages of the control plane."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Names of synopses by the numbers that requests use. Fixed values.
SYNOPSIS_IDS = {
    1: "count_min", 2: "bloom", 3: "ams", 4: "dft", 5: "lsh", 6: "coreset", 7: "hyperloglog", 8: "sticky", 9: "lossy", 10: "chain_sample",
    11: "quantiles", 12: "trajectory", 13: "topk", 15: "wor_sample", 16: "window_quantiles", 26: "finjoin", 27: "counters", 28: "simulation_windows",
    29: "past_dft", 100: "radius"
}
#: What a request does, by its number. Fixed values.
REQUEST_IDS = {1: "add", 2: "delete", 3: "estimate", 4: "add", 5: "add_continuous", 6: "join_size", 7: "update"}

DATAPOINT = T.StructType([T.StructField("dataSetkey", T.StringType()), T.StructField("streamID", T.StringType()), T.StructField("values", T.StringType())])
REQUEST = T.StructType(
    [T.StructField("dataSetkey", T.StringType()), T.StructField("requestID", T.IntegerType()), T.StructField("synopsisID", T.IntegerType()), T.StructField("uid", T.IntegerType()),
     T.StructField("streamID", T.StringType()), T.StructField("param", T.ArrayType(T.StringType())), T.StructField("noOfP", T.IntegerType())]
)
ESTIMATION = T.StructType(
    [
        T.StructField("uid", T.IntegerType()), T.StructField("requestID", T.IntegerType()), T.StructField("synopsisID", T.IntegerType()),
        T.StructField("key", T.StringType()), T.StructField("estimation", T.StringType())
    ]
)


@dataclass(frozen=True)
class SynopsisSpec:
    """A named synopsis of a dataset: the payload field that is the key, the one that is the value, and its parameters."""

    uid: int
    kind: str
    dataset: str
    key: str
    value: str | None = None
    params: dict = field(default_factory=dict)
    partitioning: str = "keyed"
    partitions: int = 1

    def __post_init__(self):
        if self.partitioning not in ("keyed", "random"):
            raise ValueError("partitioning is keyed or random")
        if self.partitions < 1:
            raise ValueError("partitions is positive")
