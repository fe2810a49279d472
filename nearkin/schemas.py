"""Column types of the engine's tables, and the identifiers of stored payloads."""

from __future__ import annotations

from pyspark.sql import types as T

#: A 128-bit hash as two signed halves.
HASH = T.StructType([T.StructField("hi", T.LongType(), False), T.StructField("lo", T.LongType(), False)])
#: A place in a media file: time base, stamp and first stamp.
MEDIA_TIME = T.StructType([T.StructField("tb_num", T.IntegerType()), T.StructField("tb_den", T.IntegerType()), T.StructField("ts", T.LongType()), T.StructField("first_ts", T.LongType())])
#: Where a stored frame comes from; mirrored is `Normal` or `Mirrored`.
FRAME_SOURCE = T.StructType([T.StructField("frame_pos", MEDIA_TIME), T.StructField("path", T.StringType()), T.StructField("mirrored", T.StringType())])
#: A frame on its way through the pipeline.
FRAME = T.StructType(
    [T.StructField("video", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("pos_ms", T.LongType()), *HASH.fields, T.StructField("mirrored", T.StringType()), T.StructField("phantom", T.BooleanType())]
)
#: An image: rows of grey or packed RGB pixels.
IMAGE = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("px", T.ArrayType(T.IntegerType()))])
RECT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "w", "h")])

# Identifiers of payload types in an index.
VIDEO, STRING, UNIT = "video:1", "string:1", "unit:1"
#: Payload column of each identifier.
PAYLOADS = {VIDEO: FRAME_SOURCE, STRING: T.StringType(), UNIT: T.BooleanType()}


class SourceMismatch(ValueError):
    """An index holds another payload type than the one it is opened for."""
