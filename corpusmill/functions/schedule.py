"""Piecewise functions of a step."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_stable_decay(step: Column, peak: float, total: int, warmup: int, decay: int, floor: float = 0.1) -> Column:
    """Linear up, level, cosine down to floor * peak over the last `decay` steps."""
    down = F.least(F.greatest((step - (total - decay)) / max(1, decay), F.lit(0.0)), F.lit(1.0))
    tail = floor + (1 - floor) * 0.5 * (1 + F.cos(pi * down))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).when(step < total - decay, F.lit(float(peak))).otherwise(peak * tail)


def ramp(step: Column, start: int, end: int, low: float = 0.0, high: float = 1.0) -> Column:
    share = F.least(F.greatest((step - start) / max(1, end - start), F.lit(0.0)), F.lit(1.0))
    return low + (high - low) * share
