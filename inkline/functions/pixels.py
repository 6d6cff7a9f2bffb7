"""Pixel values as column expressions: gray, normalization, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of blue, green, red; channel means and deviations of the imagenet normalization.
LUMA_BGR = (0.114, 0.587, 0.299)
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def gray(channels: Column) -> Column:
    """8-bit gray of an array of one, three (BGR) or four (BGRA) channels; another number of channels is an error."""
    luma = sum((F.get(channels, F.lit(k)) * w for k, w in enumerate(LUMA_BGR)), F.lit(0.0))
    wrong = F.raise_error(F.concat(F.lit("not a pixel: channels "), F.size(channels).cast("string"))).cast("int")
    return F.when(F.size(channels) == 1, F.get(channels, F.lit(0)).cast("int")).when(F.size(channels).isin(3, 4), F.least(F.greatest(F.bround(luma), F.lit(0.0)), F.lit(255.0)).cast("int")).otherwise(wrong)


def normalized(gray: Column, imagenet: bool = True) -> Column:
    """Three equal channels of an 8-bit value, by the imagenet means and deviations, or the value from 0 to 1."""
    share = gray / 255.0
    return F.array(*((share - m) / s for m, s in zip(IMAGENET_MEAN, IMAGENET_STD, strict=True))) if imagenet else share


def shown(channels: Column) -> Column:
    """Normalized channels back between 0 and 1."""
    return F.array(*(F.least(F.greatest(F.get(channels, F.lit(k)) * s + m, F.lit(0.0)), F.lit(1.0)) for k, (m, s) in enumerate(zip(IMAGENET_MEAN, IMAGENET_STD, strict=True))))


def pad_value() -> float:
    """White after imagenet normalization, averaged over channels."""
    return sum((1 - m) / s for m, s in zip(IMAGENET_MEAN, IMAGENET_STD, strict=True)) / len(IMAGENET_MEAN)


def pad_row(row: Column, width: int, value: float) -> Column:
    """A row of pixels cut, or filled on the right, to ``width``."""
    return F.when(F.size(row) >= width, F.slice(row, 1, width)).otherwise(F.concat(row, F.array_repeat(F.lit(value), F.lit(width) - F.size(row))))
