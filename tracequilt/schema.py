"""Table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from .functions import clock, ip
from .runtime import computed

FRAMES = T.StructType(
    [
        T.StructField("capture_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts_us", T.LongType(), False),
        T.StructField("captured_len", T.LongType(), False),
        T.StructField("packet_len", T.LongType(), False),
        T.StructField("link_type", T.IntegerType(), True),
        T.StructField("data", T.BinaryType(), True),
    ]
)

# One row per frame after decode.  ``seq`` is arrival order inside a capture:
# unique and increasing, not necessarily dense (the file reader uses byte offsets).
PACKETS = T.StructType(
    [
        T.StructField("capture_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts_us", T.LongType(), False),
        T.StructField("src_bin", T.BinaryType(), True),
        T.StructField("dst_bin", T.BinaryType(), True),
        T.StructField("src_port", T.IntegerType(), True),
        T.StructField("dst_port", T.IntegerType(), True),
        T.StructField("proto", T.StringType(), True),
        T.StructField("tcp_flags", T.IntegerType(), True),
        T.StructField("packet_len", T.LongType(), False),
        T.StructField("payload_len", T.LongType(), False),
        T.StructField("sni", T.StringType(), True),
        T.StructField("arp_op", T.IntegerType(), True),
        T.StructField("decoded", T.BooleanType(), False),
    ]
)

# Decoded fields; an undecodable frame carries none of them.
DECODED_FIELDS = ("src_bin", "dst_bin", "src_port", "dst_port", "proto", "tcp_flags", "sni", "arp_op")


def conform_packets(df: DataFrame) -> DataFrame:
    """Bring a user's packet table to :data:`PACKETS`.

    Accepts ``src_ip``/``dst_ip`` text instead of the binary columns and ``ts``
    (TIMESTAMP) instead of ``ts_us``; missing nullable columns become null.
    Decoded fields of undecodable frames are blanked so they cannot form groups.
    """
    have = set(df.columns)
    parsed = {
        f"{side}_bin": ip.from_text(f"{side}_ip")
        for side in ("src", "dst") if f"{side}_bin" not in have and f"{side}_ip" in have
    }
    if parsed:
        df = computed(df, **parsed)
        have |= set(parsed)
    decoded = "coalesce(decoded, true)" if "decoded" in have else "true"

    def source(name: str) -> str:
        if name == "decoded":
            return decoded
        if name in have:
            return name
        if name == "ts_us" and "ts" in have:
            ntz = isinstance(df.schema["ts"].dataType, T.TimestampNTZType)
            return clock.ntz_micros("ts") if ntz else "unix_micros(ts)"
        return "NULL"

    def value(field: T.StructField) -> str:
        column = source(field.name)
        if field.name == "payload_len":
            column = f"coalesce({column}, 0)"
        if field.name in DECODED_FIELDS:
            column = f"CASE WHEN {decoded} THEN {column} END"
        return f"CAST({column} AS {field.dataType.simpleString()}) AS {field.name}"

    return df.selectExpr(*[value(f) for f in PACKETS.fields])
