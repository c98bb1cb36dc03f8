"""Scalar and array statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_ratio(a: Column, b: Column, otherwise=0.0) -> Column:
    """a / b, or a stated value where b is zero or missing."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its maximum so large scores do not overflow."""
    peak = F.array_max(values)
    weights = F.transform(values, lambda v: F.exp(v - peak))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)


def linspace(start, stop, count: int) -> Column:
    start = start if isinstance(start, Column) else F.lit(float(start))
    stop = stop if isinstance(stop, Column) else F.lit(float(stop))
    if count == 1:
        return F.array(start.cast("double"))
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(steps, lambda i: start + (stop - start) * (i / F.lit(float(count - 1))))


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def array_corr(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays; 1 when neither varies, as histogram comparison defines it."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    n = F.size(a).cast("double")
    mean_a, mean_b = total(a) / n, total(b) / n
    cov = total(F.zip_with(a, b, lambda u, v: (u - mean_a) * (v - mean_b)))
    var_a = total(F.transform(a, lambda u: (u - mean_a) * (u - mean_a)))
    var_b = total(F.transform(b, lambda v: (v - mean_b) * (v - mean_b)))
    scale = F.sqrt(var_a * var_b)
    return F.when(scale > 2.220446049250313e-16, cov / scale).otherwise(F.lit(1.0))


def fbeta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    denominator = b2 * precision + recall
    return F.when(denominator > 0, (1 + b2) * precision * recall / denominator).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson score interval as struct<lo, hi>; (0, 1) when nothing was tried."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    z2 = z * z
    scale = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / scale
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0))
    return F.struct(low.alias("lo"), high.alias("hi"))


def drift_false_alarm_floor(delta, threshold, sigma: Column) -> Column:
    """Closed-form false-alarm floor of the drift test on a still, noisy signal."""
    delta = delta if isinstance(delta, Column) else F.lit(float(delta))
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(sigma > 0, F.exp(-2.0 * delta * threshold / (sigma * sigma))).otherwise(F.lit(0.0))


def persistence_delay(min_frames: Column, frames_per_second: Column) -> Column:
    """Seconds that waiting for ``min_frames`` sightings adds."""
    return (min_frames - 1) / frames_per_second


def upper_median(values: Column) -> Column:
    """Element n // 2 of a sorted array: the upper of the two middle values."""
    ordered = F.array_sort(values)
    return F.get(ordered, (F.size(ordered) / 2).cast("int"))
