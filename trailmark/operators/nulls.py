"""Random surfaces with a given spectrum, as null models of a cost component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _frequencies(rows: int, cols: int) -> np.ndarray:
    """Cycles a cell of the half plane that a real transform has."""
    return np.sqrt(np.square(np.fft.fftfreq(rows))[:, None] + np.square(np.fft.rfftfreq(cols))[None])


def _twins(cols: int) -> np.ndarray:
    """How often each column of the half plane stands for one of the whole plane: the inner ones also for their mirror image."""
    out = np.full(cols // 2 + 1, 2.0)
    out[0] = 1.0
    if cols % 2 == 0:
        out[-1] = 1.0
    return out


def spectral_exponent(z: np.ndarray, low: float = 0.02, high: float = 0.4, least: int = 32, otherwise: float = 2.0) -> float:
    """b of power ~ k^-b: the slope of a line through the logarithms, by the moments of the frequencies from low to high. The surface is taken
    about its mean, missing cells at the mean, and faded out to its sides (a raised cosine). With fewer than `least` frequencies there is
    no telling."""
    known = np.isfinite(z)
    if not known.any():
        return otherwise
    rows, cols = z.shape
    about = np.where(known, z, 0.0) - np.where(known, z[known].mean(), 0.0)
    fade = [0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1)) for n in (rows, cols)]
    spectrum = np.fft.rfft2(about * fade[0][:, None] * fade[1])
    power, k = spectrum.real**2 + spectrum.imag**2, _frequencies(rows, cols)
    n = np.where((k >= low) & (k <= high) & (power > 0), _twins(cols), 0.0)
    if n.sum() < least:
        return otherwise
    x, y = np.log(np.where(n > 0, k, 1.0)), np.log(np.where(n > 0, power, 1.0))
    mean_x, mean_y = (n * x).sum() / n.sum(), (n * y).sum() / n.sum()
    return float(-(n * (x - mean_x) * (y - mean_y)).sum() / (n * (x - mean_x) ** 2).sum())


def null_surface(rows: int, cols: int, exponent: float, seed: list[int], epsilon: float = 0.01, clip: tuple[float, float] = (5.0, 95.0)) -> np.ndarray:
    """A random surface of that spectrum: amplitudes k^(-exponent / 2) with independent normal real and imaginary parts, without a mean,
    brought back to the plane, clipped at percentiles and scaled to [epsilon, 1 + epsilon]; a constant one is epsilon."""
    draw = np.random.default_rng(seed)
    k = _frequencies(rows, cols)
    k[0, 0] = np.inf
    waves = (draw.standard_normal(k.shape) + 1j * draw.standard_normal(k.shape)) * k ** (-exponent / 2)
    surface = np.fft.irfft2(waves, s=(rows, cols))
    a, b = np.percentile(surface, clip)
    return epsilon + (np.minimum(np.maximum(surface, a), b) - a) / (b - a) if b > a else np.full((rows, cols), epsilon)


def null_fields(units: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(unit, m, row, col, z) for units (unit long, n_rows, n_cols, exponent) and m below draws. Each surface has its own seed of
    (seed, unit, m), so a retried task makes the same one; one surface is what a task holds."""
    spark = units.sparkSession
    jobs = units.crossJoin(F.broadcast(spark.range(draws).withColumnRenamed("id", "m"))).repartition("unit", "m")  # draws is a parameter

    def make(batches):
        for batch in batches:
            for r in batch.itertuples():
                z = null_surface(r.n_rows, r.n_cols, r.exponent, [seed, r.unit, r.m])
                row, col = np.divmod(np.arange(z.size), r.n_cols)
                yield pd.DataFrame({"unit": r.unit, "m": r.m, "row": row, "col": col, "z": z.ravel()})

    own = jobs.select(F.col("unit").cast("long"), F.col("m").cast("long"), F.col("n_rows").cast("long"), F.col("n_cols").cast("long"), F.col("exponent").cast("double"))
    return own.mapInPandas(make, "unit long, m long, row long, col long, z double")


def exponents(cells: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, n_cols, exponent) of the surfaces in (key, row, col, z)."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        r, c = p["row"].to_numpy() - p["row"].min(), p["col"].to_numpy() - p["col"].min()
        z = np.full((r.max() + 1, c.max() + 1), np.nan)
        z[r, c] = p["z"]
        return pd.DataFrame({key: p[key].iloc[:1], "n_rows": z.shape[0], "n_cols": z.shape[1], "exponent": spectral_exponent(z)})

    own = cells.select(F.col(key).cast("long").alias(key), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"))
    return own.groupBy(key).applyInPandas(one, f"{key} long, n_rows long, n_cols long, exponent double")


def p_floor(draws: Column) -> Column:
    """The smallest p that so many draws can give."""
    return 1 / (draws + 1)
