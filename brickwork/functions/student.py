"""Two-sided p-value of Student's t, as an Arrow-batched function."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Tail area of Student's t beyond ``|t|`` on both sides.

    With ``t = sqrt(df) * tan(a)`` the density becomes ``cos(a)^(df - 1)`` on a bounded
    interval. Only the tail is integrated, so small p-values keep their digits.
    """
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    for i in np.flatnonzero(np.isfinite(t) & (df > 0)):
        # Work with the complement b = pi/2 - a, where cos(a) = sin(b).
        top = math.atan2(math.sqrt(df[i]), t[i])
        log_scale = math.lgamma((df[i] + 1) / 2) - math.lgamma(df[i] / 2) - 0.5 * math.log(math.pi)
        # sin(b)^(df - 1) rises like a power at 0: b = top * u^q makes it smooth for small df,
        # and panels keep it accurate for large df.
        q = 4 if df[i] < 4 else 1
        edges = np.linspace(0.0, 1.0, 17)
        half = np.diff(edges)[:, None] / 2
        u = edges[:-1, None] + half * (1 + _NODES)
        b = top * u**q
        density = np.sin(b) ** (df[i] - 1) * top * q * u ** (q - 1)
        out[i] = min(1.0, 2 * math.exp(log_scale) * float((density * _WEIGHTS * half).sum()))
    out[np.isinf(t)] = 0.0
    return out


@F.arrow_udf(T.DoubleType())
def student_p(t: pa.Array, df: pa.Array) -> pa.Array:
    """Column form of :func:`two_sided_p`; null where it is not defined."""
    p = two_sided_p(t.to_numpy(zero_copy_only=False), df.to_numpy(zero_copy_only=False))
    return pa.array(p, pa.float64(), mask=np.isnan(p))
