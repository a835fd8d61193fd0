"""The archive's row: one captured HTTP exchange, and the schema of its flat form."""

from __future__ import annotations

from pyspark.sql import types as T

#: Ordered, with repeats, so not a map.
HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.BinaryType())]))

REQUEST = T.StructType(
    [
        T.StructField("started_at_ms", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("headers", HEADERS),
        T.StructField("complete", T.BooleanType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("body_is_text", T.BooleanType()),
    ]
)
RESPONSE = T.StructType(
    [
        T.StructField("started_at_ms", T.LongType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("headers", HEADERS),
        T.StructField("complete", T.BooleanType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("body_is_text", T.BooleanType()),
    ]
)
FRAME = T.StructType([T.StructField("sent_at_ms", T.LongType()), T.StructField("from_client", T.BooleanType()), T.StructField("opcode", T.IntegerType()), T.StructField("content", T.BinaryType())])

EXCHANGE = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("element_num", T.IntegerType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("agent", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("request", REQUEST),
        T.StructField("response", RESPONSE),
        T.StructField("finished_at_ms", T.LongType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("websocket", T.ArrayType(FRAME)),
        T.StructField("error", T.StringType()),
    ]
)
