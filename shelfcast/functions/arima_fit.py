"""Fit and extrapolation of one seasonal ARIMA series by conditional sum of squares.

The model is phi(L) Phi(L^s) (1-L)^d (1-L^s)^D y = theta(L) Theta(L^s) e (Box & Jenkins). Values and
errors before the sample count as zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 64
MAX_ROUNDS = 40
TOLERANCE = 1e-6


@dataclass(frozen=True)
class ArimaOrder:
    order: tuple[int, int, int] = (1, 0, 1)
    seasonal_order: tuple[int, int, int, int] = (1, 1, 1, 7)

    def __post_init__(self):
        if len(self.order) != 3 or len(self.seasonal_order) != 4:
            raise ValueError("order needs three numbers and seasonal_order four")
        if min(self.order) < 0 or min(self.seasonal_order) < 0:
            raise ValueError("orders must be non-negative")
        if self.seasonal_order[3] < 2 and any(self.seasonal_order[:3]):
            raise ValueError("the seasonal period must be at least 2")

    @property
    def sizes(self) -> tuple[int, int, int, int]:
        """Number of AR, seasonal AR, MA and seasonal MA coefficients."""
        return self.order[0], self.seasonal_order[0], self.order[2], self.seasonal_order[2]

    def differencing(self) -> np.ndarray:
        poly = np.ones(1)
        for _ in range(self.order[1]):
            poly = np.convolve(poly, [1.0, -1.0])
        for _ in range(self.seasonal_order[1]):
            poly = np.convolve(poly, _spread(np.array([-1.0]), self.seasonal_order[3]))
        return poly

    def polynomials(self, theta):
        """AR and MA lag polynomials (without differencing), constant term 1 first."""
        ar, sar, ma, sma = np.split(np.asarray(theta, float), np.cumsum(self.sizes)[:-1])
        s = self.seasonal_order[3]
        return np.convolve(_spread(-ar, 1), _spread(-sar, s)), np.convolve(_spread(ma, 1), _spread(sma, s))


def _spread(coefficients, stride):
    poly = np.zeros(1 + stride * len(coefficients))
    poly[0] = 1.0
    if len(coefficients):
        poly[stride::stride] = coefficients
    return poly


def _filter(poly, x):
    """poly(L) x along the first axis, values before the sample zero."""
    out = np.zeros_like(x)
    for lag in np.flatnonzero(poly):
        out[lag:] += poly[lag] * x[: len(x) - lag]
    return out


def _reciprocal(poly, size):
    """First ``size`` coefficients of 1 / poly, by Newton's iteration on power series."""
    series = np.ones(1)
    while len(series) < size:
        known = min(2 * len(series), size)
        correction = -np.convolve(poly[:known], series)[:known]
        correction[0] += 2.0
        series = np.convolve(series, correction)[:known]
        series = np.pad(series, (0, known - len(series)))
    return series


def _inverse_filter(poly, x):
    """Solve poly(L) e = x along the first axis.

    Blocks are solved together as if nothing preceded them; then the influence of each block's last
    errors on the next one is passed along.
    """
    reach = len(poly) - 1
    if reach == 0:
        return x.copy()
    size = max(BLOCK, reach)
    response = _reciprocal(poly, size)
    lag = np.subtract.outer(np.arange(size), np.arange(size))
    solve = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    # carry[i, j]: weight of the j-th of the last `reach` errors in row i of the next block
    back = np.subtract.outer(np.arange(reach), np.arange(reach)) + reach
    carry = np.where(back <= reach, poly[np.minimum(back, reach)], 0.0)
    link = solve[:, :reach] @ carry

    flat = x.reshape(len(x), -1)
    blocks, columns = -(-len(x) // size), flat.shape[1]
    padded = np.zeros((blocks * size, columns))
    padded[: len(x)] = flat
    side_by_side = padded.reshape(blocks, size, columns).transpose(1, 0, 2).reshape(size, -1)
    local = (solve @ side_by_side).reshape(size, blocks, columns)
    tails = np.zeros((blocks, reach, columns))
    for block in range(1, blocks):
        tails[block] = local[-reach:, block - 1] - link[-reach:] @ tails[block - 1]
    e = local - (link @ tails.transpose(1, 0, 2).reshape(reach, -1)).reshape(size, blocks, columns)
    return e.transpose(1, 0, 2).reshape(blocks * size, columns)[: len(x)].reshape(x.shape)


def _errors(w, theta, spec: ArimaOrder):
    ar, ma = spec.polynomials(theta)
    return _inverse_filter(ma, _filter(ar, w))


def _slopes(w, errors, theta, spec: ArimaOrder):
    """Derivative of the errors by each coefficient."""
    if not len(theta):
        return np.zeros((len(w), 0))
    _, ma = spec.polynomials(theta)
    p, sp, q, sq = spec.sizes
    s = spec.seasonal_order[3]
    ar_part, sar_part, ma_part, sma_part = np.split(np.asarray(theta, float), np.cumsum(spec.sizes)[:-1])
    inputs = []
    for count, stride, other, series in (
        (p, 1, _spread(-sar_part, s), w),
        (sp, s, _spread(-ar_part, 1), w),
        (q, 1, _spread(sma_part, s), errors),
        (sq, s, _spread(ma_part, 1), errors),
    ):
        base = -_filter(other, series) if count else None
        for k in range(1, count + 1):
            shifted = np.zeros_like(w)
            shifted[stride * k :] = base[: max(len(w) - stride * k, 0)]
            inputs.append(shifted)
    return _inverse_filter(ma, np.column_stack(inputs))


def fit_arima(values: np.ndarray, spec: ArimaOrder) -> dict:
    """Coefficients by damped Gauss-Newton steps on the sum of squared one-step errors."""
    diff = spec.differencing()
    lost = len(diff) - 1
    count = sum(spec.sizes)
    if len(values) - lost < 2 * count + 2:
        raise ValueError(f"{len(values)} observations are too few for this order")
    w = _filter(diff, values)[lost:]

    theta, damping = np.zeros(count), 1e-3
    errors = _errors(w, theta, spec)
    slopes = _slopes(w, errors, theta, spec)
    best = float(errors @ errors)
    for _ in range(MAX_ROUNDS if count else 0):
        normal = slopes.T @ slopes
        step = np.linalg.solve(
            normal + damping * np.diag(np.diag(normal)) + 1e-9 * np.eye(count), -slopes.T @ errors
        )
        with np.errstate(over="ignore", invalid="ignore"):
            trial = _errors(w, theta + step, spec)
            squared = float(trial @ trial)
        if np.isfinite(squared) and squared < best:
            gain = (best - squared) / (best or 1.0)
            theta, errors, best, damping = theta + step, trial, squared, damping / 5
            if gain < TOLERANCE:
                break
            slopes = _slopes(w, errors, theta, spec)
        else:
            damping *= 8
            if damping > 1e8:
                break

    n = len(w)
    variance = best / n
    likelihood = -0.5 * n * (np.log(2 * np.pi * max(variance, 1e-300)) + 1)
    ar, ma = spec.polynomials(theta)
    full = np.convolve(ar, diff)
    all_errors = np.concatenate([np.zeros(lost), errors])
    # Days lost to differencing are predicted from what precedes them, with zeros before the sample.
    residuals = all_errors.copy()
    residuals[:lost] = _filter(full, values)[:lost]
    return {
        "theta": theta,
        "variance": variance,
        "log_likelihood": likelihood,
        "aic": 2 * (count + 1) - 2 * likelihood,
        "bic": np.log(n) * (count + 1) - 2 * likelihood,
        "fitted": values - residuals,
        "value_tail": values[max(len(values) - len(full) + 1, 0) :],
        "error_tail": all_errors[max(len(values) - len(ma) + 1, 0) :],
    }


def extrapolate(theta, variance, value_tail, error_tail, periods: int, spec: ArimaOrder):
    """Point forecasts and standard errors for the next ``periods`` steps."""
    ar, ma = spec.polynomials(theta)
    full = np.convolve(ar, spec.differencing())
    y = np.concatenate([np.zeros(max(len(full) - 1 - len(value_tail), 0)), value_tail, np.zeros(periods)])
    e = np.concatenate([np.zeros(max(len(ma) - 1 - len(error_tail), 0)), error_tail, np.zeros(periods)])
    psi = np.zeros(periods)
    for h in range(periods):
        at, at_e = len(y) - periods + h, len(e) - periods + h
        y[at] = ma[1:] @ e[at_e - len(ma) + 1 : at_e][::-1] - full[1:] @ y[at - len(full) + 1 : at][::-1]
        reach = min(h, len(full) - 1)
        psi[h] = (ma[h] if h < len(ma) else 0.0) - full[1 : reach + 1] @ psi[h - reach : h][::-1]
    return y[len(y) - periods :], np.sqrt(variance * np.cumsum(psi**2))
