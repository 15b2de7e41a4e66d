"""Forecasts with autoregression and moving averages, by conditional sums of squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


def innovations(w: np.ndarray, c: float, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The errors e[t] = w[t] - c - sum phi[i] w[t-1-i] - sum theta[j] e[t-1-j] from t = len(phi) on; errors before are 0."""
    p, q = len(phi), len(theta)
    plain = w[p:] - c
    for i in range(p):
        plain = plain - phi[i] * w[p - 1 - i : len(w) - 1 - i]
    e = np.zeros(q + len(plain))
    for t in range(len(plain)):
        e[q + t] = plain[t] - (theta @ e[t : q + t][::-1] if q else 0.0)
    return e[q:]


def _stable(coefficients: np.ndarray) -> bool:
    """Whether x^n - c1 x^(n-1) - ... has all roots inside the unit circle."""
    return not len(coefficients) or bool(np.abs(np.roots(np.concatenate(([1.0], -coefficients)))).max() < 0.999)


def fit_order(w: np.ndarray, p: int, q: int, rounds: int = 60) -> tuple[np.ndarray, float] | None:
    """(c, phi..., theta...) with the least sum of squared innovations among stationary and invertible ones, and that sum; by damped Gauss-Newton steps."""
    if len(w) - p < 2 * (p + q + 2):
        return None
    # start: a regression on lags and, for the moving average, on the errors of a long autoregression
    reach = max(p, q)
    rough = np.zeros(len(w))
    if q:
        long = min(max(2 * q, 4), len(w) // 4)
        lags = np.column_stack([np.ones(len(w) - long), *(w[long - 1 - i : len(w) - 1 - i] for i in range(long))])
        rough[long:] = w[long:] - lags @ np.linalg.lstsq(lags, w[long:], rcond=None)[0]
    x = np.column_stack([np.ones(len(w) - reach), *(w[reach - 1 - i : len(w) - 1 - i] for i in range(p)), *(rough[reach - 1 - j : len(w) - 1 - j] for j in range(q))])
    v = np.linalg.lstsq(x, w[reach:], rcond=None)[0]
    while not (_stable(v[1 : 1 + p]) and _stable(-v[1 + p :])):
        v[1:] *= 0.8
    split = lambda v: innovations(w, v[0], v[1 : 1 + p], v[1 + p :])
    e, damp = split(v), 1e-3
    for _ in range(rounds):
        steps = 1e-6 * np.maximum(1.0, np.abs(v))
        jac = np.column_stack([(split(v + steps[k] * np.eye(len(v))[k]) - e) / steps[k] for k in range(len(v))])
        gram, slope = jac.T @ jac, jac.T @ e
        moved = False
        while damp < 1e8:
            new = v - np.linalg.solve(gram + damp * np.diag(np.diag(gram) + 1e-12), slope)
            if _stable(new[1 : 1 + p]) and _stable(-new[1 + p :]) and (e2 := split(new)) @ e2 < e @ e:
                moved = (e @ e - e2 @ e2) > 1e-10 * (e @ e)
                v, e, damp = new, e2, damp / 5
                break
            damp *= 5
        if not moved:
            break
    return v, float(e @ e)


def continued(y: np.ndarray, d: int, v: np.ndarray, p: int, ahead: int) -> np.ndarray:
    """The next values of y under a fit of its d-th differences; errors to come are 0."""
    w = np.diff(y, d) if d else y.astype(float)
    phi, theta = v[1 : 1 + p], v[1 + p :]
    e = list(innovations(w, v[0], phi, theta))
    w = list(w)
    for _ in range(ahead):
        w.append(v[0] + sum(phi[i] * w[-1 - i] for i in range(p)) + sum(theta[j] * e[-1 - j] for j in range(min(len(theta), len(e)))))
        e.append(0.0)
    out = np.array(w[-ahead:])
    for k in range(d - 1, -1, -1):
        out = np.cumsum(out) + (np.diff(y, k)[-1] if k else y[-1])
    return out


def autocorrelations(e: np.ndarray, lags: int) -> np.ndarray:
    x = e - e.mean()
    total = x @ x
    return np.array([(x[k:] @ x[:-k]) / total if 0 < k < len(x) and total > 0 else 0.0 for k in range(1, lags + 1)])


def best_order(y: np.ndarray, most: int, d: int) -> tuple[int, int, np.ndarray, float] | None:
    """p, q, fit and AIC (n log(sum / n) + 2 (p + q + 2)) of the order up to most with the lowest AIC; all conditioned on the same rows. Ties: fewer terms."""
    w = np.diff(y, d) if d else y.astype(float)
    found = None
    for p in range(most + 1):
        for q in range(most + 1):
            fit = fit_order(w, p, q)
            if fit is None:
                continue
            e = innovations(w, fit[0][0], fit[0][1 : 1 + p], fit[0][1 + p :])[most - p :]
            if len(e) < 2:
                continue
            aic = len(e) * np.log(max(float(e @ e), 1e-300) / len(e)) + 2 * (p + q + 2)
            if found is None or (round(aic, 9), p + q, p) < (round(found[3], 9), found[0] + found[1], found[0]):
                found = p, q, fit[0], float(aic)
    return found


def arima_grid(df: DataFrame, group: str, at: str, value: str, ahead: int = 20, most: int = 3, d: int = 1) -> DataFrame:
    """group, step (1..ahead), forecast, p, q, aic, residual_acf: each group's series in order of at, continued by the ARIMA(p, d, q) with the lowest AIC up to order most.

    A series has a value for each period, an aggregate of many rows, so a group is short. Missing values are left out; a series too short for any order
    repeats its last value, with null order. residual_acf is the largest absolute autocorrelation of the errors at the first ten lags.
    """
    schema = StructType([df.schema[group], StructField("step", LongType())]).add("forecast", "double").add("p", "long").add("q", "long").add("aic", "double").add("residual_acf", "double")

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values(at)[value].astype(float).dropna().to_numpy()
        got = best_order(y, most, d) if len(y) > d + 3 else None
        if got is None:
            out = {"forecast": [float(y[-1]) if len(y) else None] * ahead, "p": None, "q": None, "aic": None, "residual_acf": None}
        else:
            p, q, v, aic = got
            w = np.diff(y, d) if d else y
            out = {"forecast": continued(y, d, v, p, ahead), "p": p, "q": q, "aic": aic, "residual_acf": float(np.abs(autocorrelations(innovations(w, v[0], v[1 : 1 + p], v[1 + p :]), 10)).max())}
        frame = pd.DataFrame({group: [frame[group].iloc[0]] * ahead, "step": range(1, ahead + 1)} | out)
        return frame.astype({"p": "Int64", "q": "Int64"}) if got is None else frame

    return df.select(group, at, value).groupBy(group).applyInPandas(of, schema)
