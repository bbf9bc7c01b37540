"""Polarization expressions: Stokes parameters, degree and angle of linear polarization, harmonic fits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stokes_four(i0: Column, i45: Column, i90: Column, i135: Column) -> tuple[Column, Column, Column]:
    return (i0 + i45 + i90 + i135) / 2, i0 - i90, i45 - i135


def harmonic_weights(angles: list[float], order: int = 1) -> list[list[float]]:
    """Least-squares weights of evenly or unevenly spaced analyzer angles (degrees): one row for each of 1, cos 2kt, sin 2kt.

    Small normal equations solved on the driver (2 * order + 1 unknowns); too few angles raise.
    """
    import numpy as np

    t = np.radians(angles)
    basis = np.stack([np.ones_like(t)] + [f(2 * k * t) for k in range(1, order + 1) for f in (np.cos, np.sin)], axis=1)
    if np.linalg.matrix_rank(basis) < basis.shape[1]:
        raise ValueError("angles do not determine the fit")
    return np.linalg.pinv(basis).tolist()


def fit(values: list[Column], weights: list[list[float]]) -> list[Column]:
    return [sum((w * v for w, v in zip(row, values, strict=True)), F.lit(0.0)) for row in weights]


def stokes_fit(values: list[Column], angles: list[float]) -> list[Column]:
    """S0, S1, S2 from intensities at three or more angles: I = (S0 + S1 cos 2t + S2 sin 2t) / 2."""
    return [2 * c for c in fit(values, harmonic_weights(angles))]


def analyzer(s0: Column, s1: Column, s2: Column, degrees: Column | float, t_max: float = 1.0, t_min: float = 0.0) -> Column:
    """Intensity behind a linear analyzer with the given transmissions along and across."""
    t = F.radians(F.lit(degrees) if isinstance(degrees, (int, float)) else degrees)
    return 0.5 * ((t_max + t_min) * s0 + (t_max - t_min) * (s1 * F.cos(2 * t) + s2 * F.sin(2 * t)))


def dolp(s0: Column, s1: Column, s2: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.hypot(s1, s2) / F.greatest(s0, F.lit(1e-8))))


def aolp(s1: Column, s2: Column) -> Column:
    return 0.5 * F.atan2(s2, s1)


def aolp_gap(a: Column, b: Column) -> Column:
    """Distance of two angles of polarization, which repeat after pi."""
    d = F.pmod(F.abs(a - b), F.lit(math.pi))
    return F.least(d, math.pi - d)
