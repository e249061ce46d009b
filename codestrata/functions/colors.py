"""Colours and map positions."""

from pyspark.sql import Column, functions as F

from .numbers import capped_ratio
from .paths import parent_folder


def _channel(x: Column) -> Column:
    """Two hex digits of ``x * 255`` truncated; a sign counts as one of the two places."""
    n = (x * 255).cast("int")
    return (F.when(n < 0, F.concat(F.lit("-"), F.lower(F.hex(-n))))
            .otherwise(F.lpad(F.lower(F.hex(n)), 2, "0")))


def hsv_hex(health: Column) -> Column:
    """Red (0) to green (1): hue ``0.3 * health``, saturation 0.8, value 0.9."""
    turn = health * 0.3 * 6.0
    sector = turn.cast("int")
    part = turn - sector
    value = F.lit(0.9)
    low = F.lit(0.9 * (1.0 - 0.8))
    falling = F.lit(0.9) * (F.lit(1.0) - F.lit(0.8) * part)
    rising = F.lit(0.9) * (F.lit(1.0) - F.lit(0.8) * (F.lit(1.0) - part))
    red = F.when(sector == 0, value).otherwise(falling)
    green = F.when(sector == 0, rising).otherwise(value)
    return F.concat(F.lit("#"), _channel(red), _channel(green), _channel(low))


def health_color(frequency: Column, complexity: Column) -> Column:
    return hsv_hex(1 - (capped_ratio(frequency, 50) * 0.4 + capped_ratio(complexity, 30) * 0.6))


def node_color(in_degree: Column, out_degree: Column, size: Column, n_nodes: Column) -> Column:
    coupling = (in_degree + out_degree) / F.greatest(n_nodes, F.lit(1))
    return hsv_hex(1 - (coupling * 0.5 + capped_ratio(size, 1000) * 0.5))


def path_position(path: Column) -> Column:
    """``struct(x, y, z)``: angle from the parent folder's checksum, radius from the depth."""
    depth = F.size(F.split(path, "/"))
    folder = parent_folder(path)
    angle = F.coalesce(F.pmod(F.crc32(folder), F.lit(360)), F.lit(0))
    radius = depth * 20
    return F.struct((radius * F.cos(F.radians(angle))).alias("x"),
                    (depth * 10).cast("double").alias("y"),
                    (radius * F.sin(F.radians(angle))).alias("z"))
