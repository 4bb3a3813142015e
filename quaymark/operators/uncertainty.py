"""Out-of-distribution scores against an explicit reference set."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The reference set is a parameter of the model, not a sample of the corpus: it must fit a task and is refused beyond this.
MOST_REFERENCES = 20_000


@dataclass(frozen=True)
class Reference:
    vectors: np.ndarray
    knn_scale: float
    energy_center: float
    energy_scale: float


def _distances(x: np.ndarray, reference: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (reference * reference).sum(1)[None, :] - 2 * x @ reference.T
    return np.sqrt(np.maximum(square, 0))


def _energy(distances: np.ndarray) -> np.ndarray:
    """Negative log of the mean Gaussian kernel: it rises far from the reference set."""
    logits = -0.5 * distances**2
    top = logits.max(axis=1)
    return -(top + np.log(np.exp(logits - top[:, None]).mean(axis=1)))


def fit(vectors: np.ndarray, k: int = 5, least: int = 20) -> Reference | None:
    """Scales by leave-one-out distances to the k-th neighbour and by energies; None with fewer than `least` references."""
    if len(vectors) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} reference vectors")
    if len(vectors) < max(2, least):
        return None
    d = _distances(vectors, vectors)
    energy = _energy(d)
    np.fill_diagonal(d, np.inf)
    kth = np.partition(d, min(k, len(d) - 1) - 1, axis=1)[:, min(k, len(d) - 1) - 1]
    center = float(np.median(energy))
    return Reference(vectors, max(float(np.quantile(kth, 0.9)), 1e-12), center, max(float(np.quantile(np.abs(energy - center), 0.9)), 1e-12))


def ood_scores(rows: DataFrame, uid: str, vector: str, reference: Reference | None, k: int = 5) -> DataFrame:
    """uid, knn_distance, energy, ood (0 within the reference population, towards 1 outside), available; the reference goes to
    every task once. Null and empty vectors and vectors of another length are not available."""
    shared = rows.sparkSession.sparkContext.broadcast(reference)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = shared.value
        for pdf in batches:
            out = pd.DataFrame({uid: pdf[uid], "knn_distance": np.nan, "energy": np.nan, "ood": np.nan, "available": False})
            fits = np.array([ref is not None and v is not None and len(v) == ref.vectors.shape[1] for v in pdf[vector]], bool)
            if fits.any():
                d = _distances(np.stack(pdf[vector][fits].to_list()).astype(float), ref.vectors)
                near = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                energy = _energy(d)
                score = 1 - np.exp(-0.5 * np.maximum(0, near / ref.knn_scale - 1) - 0.5 * np.maximum(0, (energy - ref.energy_center) / ref.energy_scale))
                out.loc[fits, ["knn_distance", "energy", "ood"]] = np.stack([near, energy, np.minimum(1, score)], 1)
                out.loc[fits, "available"] = True
            yield out

    out = rows.select(uid, vector).mapInPandas(run, f"{uid} {dict(rows.dtypes)[uid]}, knn_distance double, energy double, ood double, available boolean")
    return out.select(uid, *[F.when(F.col("available"), F.col(c)).alias(c) for c in ("knn_distance", "energy", "ood")], "available")
