"""The two table shapes of the engine."""

from pyspark.sql import types as T

#: One operation: the newest per key (highest seq) decides; value is null exactly for deletes.
OPS = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("is_delete", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)

#: What reads return.
LIVE = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
