"""Sensor time and label helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time stamp types of the sensor packets.
STAMP_NO_SYNC, STAMP_PTP, STAMP_RESERVED, STAMP_PPS_GPS, STAMP_PPS = 0, 1, 2, 3, 4


def sensor_time_ns(stamp: Column, stamp_type: Column, time_rcv: Column) -> Column:
    """Packet stamp to nanoseconds.

    A PPS stamp counts from the last pulse, so the receive time is added. A PPS-GPS
    stamp holds year since 2000, month, day, hour in its four low bytes and the
    microseconds within the hour in its high word.
    """
    def byte(i: int) -> Column:
        return F.shiftright(stamp, 8 * i).bitwiseAND(F.lit(0xFF)).cast("int")

    hour = F.make_timestamp(byte(0) + 2000, byte(1), byte(2), byte(3), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    micros = F.unix_micros(hour) + F.shiftrightunsigned(stamp, 32)
    return (
        F.when(stamp_type == STAMP_PPS, stamp + time_rcv)
        .when(stamp_type.isin(STAMP_NO_SYNC, STAMP_PTP), stamp)
        .when(stamp_type == STAMP_PPS_GPS, micros * 1000)
        .otherwise(F.lit(0).cast("bigint"))
    )


def point_offset_ns(packet_offset: Column, index: Column, interval: int, echoes: int = 1) -> Column:
    """Offset of the i-th point: points of one shot share an offset."""
    return packet_offset + F.floor(index / echoes) * interval


def semantic_id(label: Column) -> Column:
    return label.bitwiseAND(F.lit(0xFFFF))


def object_class(identifier: Column) -> Column:
    return F.floor(identifier / 1000).cast("int")


def is_dynamic(identifier: Column) -> Column:
    return (identifier >= 251) & (identifier < 65535)
