"""Column names, keys and types shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# One hit as it is stored in event files.
HIT = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("energy", T.FloatType()),
        T.StructField("channel", T.IntegerType()),
    ]
)

# Nested form: one row per event.
EVENTS = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("side1", T.ArrayType(HIT)),
        T.StructField("side2", T.ArrayType(HIT)),
        T.StructField("corrupt", T.BooleanType()),
    ]
)

# An event is identified by its file (a 64-bit hash of the whole path, so files of other runs, listings and streams keep
# theirs) and its ordinal in that file. The ordinal comes first: it tells most rows apart, so sorts by these keys rarely
# look beyond it.
EVENT = ["event_id", "file_id"]
SIDE = [*EVENT, "side"]
MODULE = ["sm", "mm"]

# Fixed value: the hit counter of an event side is one unsigned byte.
MAX_HITS_PER_SIDE = 255

# Dimension tables above this row count are never hinted for broadcast.
MAX_BROADCAST_ROWS = 1_000_000
