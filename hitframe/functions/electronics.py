"""Channel id <-> electronics numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channels per port, per slave, per chip.
PORT_CHANNELS = 131072
SLAVE_CHANNELS = 4096
CHIP_CHANNELS = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def port(channel: Column | str) -> Column:
    return _div(_col(channel), PORT_CHANNELS)


def slave(channel: Column | str) -> Column:
    return _div(_col(channel) % PORT_CHANNELS, SLAVE_CHANNELS)


def chip(channel: Column | str) -> Column:
    return _div(_col(channel) % SLAVE_CHANNELS, CHIP_CHANNELS)


def chip_channel(channel: Column | str) -> Column:
    return (_col(channel) % CHIP_CHANNELS).cast("int")


def electronics(channel: Column | str) -> list[Column]:
    """The four numbers as columns ``port, slave, chip, chip_channel``."""
    return [
        port(channel).alias("port"),
        slave(channel).alias("slave"),
        chip(channel).alias("chip"),
        chip_channel(channel).alias("chip_channel"),
    ]


def absolute_id(port_id: Column, slave_id: Column, chip_id: Column, channel_id: Column) -> Column:
    """Inverse of the four numbers."""
    return port_id * PORT_CHANNELS + slave_id * SLAVE_CHANNELS + chip_id * CHIP_CHANNELS + channel_id
