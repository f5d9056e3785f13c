"""Fit of one series by trend, seasonality, holidays and regressors (Taylor & Letham, 2018).

The trend is piecewise linear in scaled time; the other terms are linear, either added to the trend
or multiplying it. Coefficients are the posterior mode: normal priors give a ridge
penalty, the Laplace prior of the trend changes a reweighted one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREND_SCALE = 5.0  # prior scale of the initial slope and level
MAX_ROUNDS = 6
TOLERANCE = 5e-3
NOISE_FLOOR = 1e-10


@dataclass(frozen=True)
class TrendOptions:
    growth: str = "linear"
    cap: float | None = None
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    changepoint_prior_scale: float = 0.05


def fourier_terms(day: np.ndarray, period: float, order: int) -> np.ndarray:
    """One row per term: sin, cos for k = 1..order. Terms are rows throughout, so that each is
    contiguous in memory."""
    angle = 2 * np.pi * np.arange(1, order + 1)[:, None] * day / period
    return np.stack([np.sin(angle), np.cos(angle)], axis=1).reshape(2 * order, len(day))


_tables: dict[tuple, np.ndarray] = {}
TABLE_STEP = 512
MAX_TABLES = 64


def seasonal_terms(first_day: int, steps: np.ndarray, period: float, order: int) -> np.ndarray:
    """Fourier terms of the days ``first_day + steps``, from a table kept between series: most
    series, and all cutoffs of one series, start on the same day."""
    size = -(-(int(steps[-1]) + 1) // TABLE_STEP) * TABLE_STEP
    key = (first_day, size, period, order)
    if key not in _tables:
        if len(_tables) >= MAX_TABLES:
            _tables.clear()
        _tables[key] = fourier_terms(first_day + np.arange(size, dtype=float), period, order)
    table = _tables[key]
    return table[:, : len(steps)] if steps[-1] + 1 == len(steps) else table[:, steps]


def changepoints(steps: np.ndarray, options: TrendOptions) -> np.ndarray:
    """Steps at which the slope may change: evenly spaced over the first part of the history."""
    early = int(np.floor(len(steps) * options.changepoint_range))
    count = max(min(options.n_changepoints, early - 1), 0)
    return steps[np.linspace(0, max(early - 1, 0), count + 1).round().astype(int)[1:]]


def fit_additive(steps, values, terms, prior_scales, multiplicative, options: TrendOptions) -> dict:
    """``terms`` has one row per term; ``multiplicative`` marks those that scale the trend."""
    if len(values) < 2:
        raise ValueError("a series needs at least 2 observations")
    span = float(steps[-1] - steps[0])
    t = (steps - steps[0]) / span
    scale = float(np.max(np.abs(values))) or 1.0
    y = values / scale
    knots = changepoints(steps, options)
    knot_t = (knots - steps[0]) / span
    n_trend = 2 + len(knots)
    design = np.empty((n_trend + len(terms), len(y)))
    design[0] = 1.0
    design[1] = t
    np.maximum(t - knot_t[:, None], 0, out=design[2:n_trend])
    design[n_trend:] = terms

    cap = (options.cap or 0.0) / scale
    theta = np.zeros(len(design))
    plain = options.growth == "linear" and not multiplicative.any()
    if options.growth == "logistic":
        share = np.clip(y / cap, 0.01, 0.99)
        theta[:2] = np.polyfit(t, np.log(share / (1 - share)), 1)[::-1]
    elif not plain:
        theta[0] = y.mean()

    precision = np.empty(len(theta))
    precision[:2] = TREND_SCALE**-2.0
    precision[n_trend:] = prior_scales**-2.0
    precision[2:n_trend] = options.changepoint_prior_scale**-2.0
    noise = max(float(y.var()), NOISE_FLOOR)
    jacobian, response = design, y
    for round_ in range(MAX_ROUNDS):
        if not plain:
            fitted, jacobian = _linearise(theta, design, n_trend, multiplicative, options.growth, cap)
            response = y - fitted + theta @ jacobian
        if round_ == 0 or not plain:
            gram, target, power = jacobian @ jacobian.T, jacobian @ response, response @ response
        penalised = gram.copy()
        penalised.flat[:: len(theta) + 1] += noise * precision
        previous, theta = theta, np.linalg.solve(penalised, target)
        noise = max(float(power - 2 * theta @ target + theta @ gram @ theta) / len(y), NOISE_FLOOR)
        # The Laplace prior as a normal one of matching slope at the current change.
        precision[2:n_trend] = 1 / (options.changepoint_prior_scale * np.maximum(np.abs(theta[2:n_trend]), 1e-5))
        if np.max(np.abs(theta - previous)) < TOLERANCE:
            break

    fitted = theta @ design if plain else _linearise(theta, design, n_trend, multiplicative, options.growth, cap)[0]
    changes = theta[2:n_trend]
    return {
        "scale": scale,
        "span": span,
        "knots": knots,
        # Segment j runs from knot j-1 (or the start) and has trend offset[j] + slope[j] * t.
        "slope": theta[1] + np.concatenate([[0.0], np.cumsum(changes)]),
        "offset": theta[0] - np.concatenate([[0.0], np.cumsum(changes * knot_t)]),
        "beta": theta[n_trend:],
        "sigma": float(np.sqrt(np.mean((y - fitted) ** 2))),
        # Variance of a future slope change times their rate per unit of scaled time.
        "drift": float(2 * np.mean(np.abs(changes)) ** 2 * len(changes)) if len(changes) else 0.0,
    }


def _linearise(theta, design, n_trend, multiplicative, growth, cap):
    """Model values and their derivatives at ``theta``."""
    line = theta[:n_trend] @ design[:n_trend]
    if growth == "logistic":
        share = 1 / (1 + np.exp(-line))
        trend, inner = cap * share, cap * share * (1 - share)
    else:
        trend, inner = line, np.ones_like(line)
    terms, effect = design[n_trend:], theta[n_trend:]
    factor = 1 + np.where(multiplicative, effect, 0) @ terms
    fitted = trend * factor + np.where(multiplicative, 0, effect) @ terms
    jacobian = design.copy()
    jacobian[:n_trend] *= inner * factor
    jacobian[n_trend:][multiplicative] *= trend
    return fitted, jacobian
