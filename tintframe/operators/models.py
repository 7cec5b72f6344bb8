"""Colour models that compete with the fitted stages, each scored by leaving one patch out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import col3, linear_srgb_to_xyz, with_delta_e, xyz_d65_to_lab
from .calibration import MEAN, with_targets

TARGET = ("t_r", "t_g", "t_b")
MODELS = ("linear", "polynomial", "root_polynomial_2", "root_polynomial_3")


def terms(model: str, rgb: np.ndarray) -> np.ndarray:
    """A model's terms of each row of colours. Roots keep the sign of what they are taken of."""
    r, g, b = rgb.T
    root = lambda v, k: np.sign(v) * np.abs(v) ** (1 / k)
    linear = [r, g, b]
    two = [root(r * g, 2), root(g * b, 2), root(r * b, 2)]
    three = [root(v, 3) for v in (r * g * g, g * b * b, r * b * b, g * r * r, b * g * g, b * r * r, r * g * b)]
    return np.stack({"linear": linear, "polynomial": [*linear, r * g * b, np.ones_like(r)], "root_polynomial_2": linear + two, "root_polynomial_3": linear + two + three}[model], axis=1)


def left_out(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What the least-squares fit to all other rows predicts for each row.

    The fit without a row misses it by its residual over one less its leverage, so one factorisation serves all rows. Rows whose
    leverage is one (the others do not determine the fit), and all rows of too few or dependent terms, are fitted anew by least norm.
    """
    q, r = np.linalg.qr(a) if len(a) >= a.shape[1] else (None, None)
    if q is not None:
        size = np.abs(np.diag(r))
        leverage = (q * q).sum(axis=1)
        if size.min() > 1e-10 * size.max():
            fitted = q @ (q.T @ t)
            weight = 1 - leverage
            odd = np.flatnonzero(weight < 1e-9)
            out = t - (t - fitted) / np.where(weight < 1e-9, 1, weight)[:, None]
        else:
            odd, out = np.arange(len(a)), np.empty_like(t)
    else:
        odd, out = np.arange(len(a)), np.empty_like(t)
    for i in odd:
        rest = np.arange(len(a)) != i
        out[i] = a[i] @ np.linalg.lstsq(a[rest], t[rest], rcond=None)[0] if rest.any() else np.nan
    return out


def predictions(samples: DataFrame, reference: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """frame, model, patch_idx, out_r, out_g, out_b: each patch as the model fitted to the frame's other patches sees it.

    A frame is at most 24 rows. Exposure and channel scales drop out: a scaled channel scales terms, which a least-squares fit undoes.
    """

    def of_frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("patch_idx")
        rgb, t = pdf[list(MEAN)].to_numpy(float), pdf[list(TARGET)].to_numpy(float)
        parts = []
        for model in models:
            out = left_out(terms(model, rgb), t)
            parts.append(pd.DataFrame({"frame": pdf["frame"].to_numpy(), "model": model, "patch_idx": pdf["patch_idx"].to_numpy(), "out_r": out[:, 0], "out_g": out[:, 1], "out_b": out[:, 2]}))
        return pd.concat(parts)

    joined = with_targets(samples, reference).select("frame", "patch_idx", *MEAN, *TARGET)
    return joined.groupBy("frame").applyInPandas(of_frame, f"frame {dict(samples.dtypes)['frame']}, model string, patch_idx int, out_r double, out_g double, out_b double")


def scored(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """``predicted`` with its Lab and delta_e from the patch's target."""
    rows = predicted.join(F.broadcast(reference.select("patch_idx", "t_l", "t_a", "t_bb")), "patch_idx")
    rows = rows.withColumns(dict(zip(("_x", "_y", "_z"), linear_srgb_to_xyz(col3("out_r", "out_g", "out_b")), strict=True)))
    rows = rows.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), xyz_d65_to_lab(col3("_x", "_y", "_z")), strict=True)))
    return with_delta_e(rows.drop("_x", "_y", "_z"), ("lab_l", "lab_a", "lab_b"), ("t_l", "t_a", "t_bb"), "delta_e")


def comparison(scores: DataFrame) -> DataFrame:
    """frame, model and the mean, median, 95th percentile and largest difference over the patches left out."""
    return scores.groupBy("frame", "model").agg(
        F.avg("delta_e").alias("mean_delta_e"),
        F.median("delta_e").alias("median_delta_e"),
        F.percentile("delta_e", 0.95).alias("p95_delta_e"),
        F.max("delta_e").alias("max_delta_e"),
    )
