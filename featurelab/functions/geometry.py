"""Angles of strokes as columns. The y axis points down: bin 2 is downward."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 8


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def direction_bin(angle: Column) -> Column:
    """Bin 0..7 of an angle, by floor."""
    return F.pmod(F.floor(F.pmod(angle, F.lit(2 * np.pi)) * BINS / F.lit(2 * np.pi)), F.lit(BINS)).cast("int")


def wrapped(angle: Column) -> Column:
    """The angle between -pi and pi."""
    return F.pmod(angle + np.pi, F.lit(2 * np.pi)) - np.pi


def turn_bin(turn: Column) -> Column:
    """Bin 0..7 of a wrapped turn between -pi and pi."""
    return F.pmod(F.floor((turn + np.pi) * BINS / F.lit(2 * np.pi)), F.lit(BINS)).cast("int")
