"""Observables of loop transports, as small matrices in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = "holonomy_norm double, trace_normalized double, spectrum_abs_mean double, spectrum_abs_max double"


def loop_observables(matrix: Column | str) -> Column:
    """Of a square matrix, flat by rows: the Frobenius norm of its distance from the identity, its trace by its size, mean and largest absolute eigenvalue.

    Null, empty and non-square arrays give nulls.
    """

    @F.pandas_udf(_OUT)
    def observe(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = []
            for m in s:
                n = 0 if m is None else int(round(len(m) ** 0.5))
                if n == 0 or n * n != len(m):
                    rows.append((None,) * 4)
                    continue
                a = np.asarray(m, np.float64).reshape(n, n)
                spectrum = np.abs(np.linalg.eigvals(a))
                rows.append((float(np.linalg.norm(a - np.eye(n))), float(np.trace(a) / n), float(spectrum.mean()), float(spectrum.max())))
            yield pd.DataFrame(rows, columns=["holonomy_norm", "trace_normalized", "spectrum_abs_mean", "spectrum_abs_max"], dtype=float)

    return observe(matrix)


def composed(path: Column | str, n: int) -> Column:
    """The product of a path of n x n matrices (an array of flat arrays), first to last, without Python."""
    ident = F.array(*[F.lit(1.0 if i % (n + 1) == 0 else 0.0) for i in range(n * n)])

    def times(a: Column, b: Column) -> Column:
        return F.array(*[sum((a[i * n + k] * b[k * n + j] for k in range(1, n)), a[i * n] * b[j]) for i in range(n) for j in range(n)])

    return F.aggregate(path, ident, times)


def path_spread(transports: DataFrame, key: str, matrix: str) -> DataFrame:
    """key, spread: the mean over all entries of the variance of a key's transports; 0 where they are all alike. Null transports count for nothing."""
    entries = transports.select(key, F.posexplode(matrix).alias("_i", "_x")).groupBy(key, "_i").agg(F.var_pop(F.col("_x").cast("double")).alias("_v"))
    return entries.groupBy(key).agg(F.avg("_v").alias("spread"))
