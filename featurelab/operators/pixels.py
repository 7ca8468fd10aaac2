"""Feature operators that are column expressions over ``pixels``, an array of 784 doubles by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 28
N = SIDE * SIDE


def checked(pixels: Column) -> Column:
    """``pixels``, or an error: 784 finite values between 0 and 1."""
    return F.when(is_image(pixels), pixels).otherwise(F.raise_error(F.lit("image must be 28 x 28 finite values in [0, 1]")))


def is_image(pixels: Column) -> Column:
    bad = F.exists(pixels, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    return F.coalesce((F.size(pixels) == N) & ~bad, F.lit(False))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def raw_pixels(pixels: Column) -> Column:
    return pixels


def downsampled(pixels: Column) -> Column:
    """Means of 2 x 2 blocks: 196 values by row."""

    def block(k: Column) -> Column:
        at = (F.floor(k / 14) * 56 + (k % 14) * 2).cast("int")
        return (F.get(pixels, at) + F.get(pixels, at + 1) + F.get(pixels, at + 28) + F.get(pixels, at + 29)) / 4

    return F.transform(F.sequence(F.lit(0), F.lit(195)), block)


def spatial(pixels: Column) -> Column:
    """Ink shares of the rows 0-8, 9-18 and 19-27; zeros if blank."""
    total = _sum(pixels)
    bands = [_sum(F.slice(pixels, a * SIDE + 1, n * SIDE)) for a, n in ((0, 9), (9, 10), (19, 9))]
    return F.array(*[F.when(total > 0, b / total).otherwise(0.0) for b in bands])


def symmetry(pixels: Column) -> Column:
    """1 - sum |a - mirror| / (2 * mass), left-right and top-bottom; ones if blank."""
    mass = _sum(pixels)
    places = F.sequence(F.lit(0), F.lit(N - 1))
    left = F.transform(places, lambda i: F.abs(F.get(pixels, i) - F.get(pixels, (i - i % SIDE + (SIDE - 1) - i % SIDE).cast("int"))))
    top = F.transform(places, lambda i: F.abs(F.get(pixels, i) - F.get(pixels, ((SIDE - 1 - F.floor(i / SIDE)) * SIDE + i % SIDE).cast("int"))))
    return F.array(*[F.when(mass > 0, 1 - _sum(d) / (2 * mass)).otherwise(1.0) for d in (left, top)])
