"""Deterministic statistics of one ordered vector, in NumPy. Null values aren't filled: what needs a complete vector refuses one that isn't."""

from __future__ import annotations

import math

import numpy as np


class Refused(ValueError):
    """The data don't allow an answer; args[0] says why."""


def loess(y: np.ndarray, window: int, weights: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Local linear smoothing at positions (default 0..n-1) with tricube weights over the window nearest points."""
    n, x = len(y), np.arange(len(y), dtype=float)
    at, q, out = x if at is None else at, min(window, len(y)), []
    for p in at:
        lo = int(min(max(round(p) - q // 2, 0), n - q))
        xs, ys = x[lo : lo + q], y[lo : lo + q]
        far = max(abs(p - xs[0]), abs(xs[-1] - p), 1.0) * (1 if window <= n else window / n)
        w = np.clip(1 - (np.abs(xs - p) / (far * 1.0001)) ** 3, 0, 1) ** 3 * weights[lo : lo + q]
        if w.sum() <= 0:
            w = np.ones(q)
        w = w / w.sum()
        mx, my = w @ xs, w @ ys
        var = w @ (xs - mx) ** 2
        out.append(my + ((w @ ((xs - mx) * (ys - my))) / var * (p - mx) if var > 1e-12 else 0.0))
    return np.array(out)


def stl(y: np.ndarray, period: int, robust: int = 15, inner: int = 2, seasonal: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal, trend and residual by seasonal-trend decomposition with loess (Cleveland et al. 1990)."""
    n = len(y)
    trend_window = math.ceil(1.5 * period / (1 - 1.5 / seasonal)) | 1
    low = (period + 1) | 1
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    mean = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
    for _ in range(robust):
        for _ in range(inner):
            free = y - trend
            cycle = np.empty(n + 2 * period)
            for s in range(period):
                sub, w = free[s::period], weights[s::period]
                cycle[s::period] = loess(sub, seasonal, w, np.arange(-1, len(sub) + 1, dtype=float))[: len(cycle[s::period])]
            smooth = mean(mean(mean(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(smooth, low, np.ones(len(smooth)))
            trend = loess(y - season, trend_window, weights)
        rest = np.abs(y - season - trend)
        h = 6 * np.median(rest)
        new = np.ones(n) if h <= 0 else np.clip(1 - (rest / h) ** 2, 0, 1) ** 2
        if np.allclose(new, weights, atol=1e-4):
            break
        weights = new
    return season, trend, y - season - trend


def anomalies(values: list[float | None], period: int, sensitivity: float = 3.5) -> list[dict]:
    """index, observed, expected, score, direction of robust seasonal outliers, in each run of values without a gap that holds two periods."""
    runs, start = [], None
    for i, v in enumerate([*values, None]):
        if v is not None and start is None:
            start = i
        if v is None and start is not None:
            runs.append((start, i))
            start = None
    runs = [r for r in runs if r[1] - r[0] >= 2 * period]
    if not runs:
        raise Refused("no run of observations holds two periods")
    out = []
    for a, b in runs:
        y = np.array(values[a:b], float)
        rest = stl(y, period)[2]
        mid = np.median(rest)
        spread = 1.4826 * np.median(np.abs(rest - mid))
        z = (rest - mid) / max(spread, np.finfo(float).eps * 100 * max(1.0, np.abs(rest).max(), np.abs(y).max()))
        out += [{"index": a + int(i), "observed": float(y[i]), "expected": float(y[i] - rest[i]), "score": float(z[i]), "direction": "high" if z[i] > 0 else "low"} for i in np.flatnonzero(np.abs(z) >= sensitivity)]
    return out


def pelt(y: np.ndarray, penalty: float, min_size: int, jump: int = 1) -> list[int]:
    """First positions of the segments after the first, of the segmentation with the least squared error plus penalty for each; states that can't win again are pruned."""
    n, s, s2 = len(y), np.concatenate(([0.0], np.cumsum(y))), np.concatenate(([0.0], np.cumsum(y * y)))
    cost = lambda a, b: s2[b] - s2[a] - (s[b] - s[a]) ** 2 / (b - a)
    best, last, open_ = {0: -penalty}, {}, [0]
    for end in sorted({*range(0, n, jump), n} - {0}):
        if end < min_size:
            continue
        able = [(best[a] + cost(a, end) + penalty, a) for a in open_ if end - a >= min_size]
        if not able:
            continue
        best[end], last[end] = min(able)
        open_ = [a for a in open_ if end - a < min_size or best[a] + cost(a, end) <= best[end]] + [end]
    out, at = [], n
    while at in last and last[at]:
        at = last[at]
        out.append(at)
    return out[::-1]


def change_points(values: list[float], level_penalty: float, trend_penalty: float, min_size: int) -> list[tuple[int, str]]:
    """(index, level or trend), sorted: breaks of the values and of their first differences."""
    if any(v is None or not math.isfinite(v) for v in values):
        raise Refused("missing values")
    if len(values) - 1 < 2 * min_size:
        raise Refused("too few values")
    y = np.array(values, float)
    return sorted([(i, "level") for i in pelt(y, level_penalty, min_size)] + [(i + 1, "trend") for i in pelt(np.diff(y), trend_penalty, min_size)])


def penalties(values: list[float]) -> tuple[float, float]:
    if len(values) < 3:
        return 1.0, 1.0
    k = 3 * math.log(max(len(values), 2))
    return tuple(float(v) * k or 1.0 for v in (np.var(values), np.var(np.diff(values))))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution by the regularised incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b or 1e-300), b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def unit_root(y: np.ndarray, most: int | None = None, trend: int = 1) -> tuple[float, int]:
    """The augmented Dickey-Fuller statistic and its lag, chosen by the Akaike criterion over a common sample. Trend is 0 for no term, 1 for a constant, 2 for a constant and a line.

    Values are scaled, and centred where the model has a constant, and columns have unit length: the statistic doesn't change by it, and large values keep their digits."""
    if len(y) < trend + 3:
        raise Refused("too few values")
    most = math.ceil(12 * (len(y) / 100) ** 0.25) if most is None else most
    most = max(min(most, len(y) // 2 - trend - 1), 0)
    y = y - y.mean() if trend else y
    y = y / (np.abs(y).max() or 1.0)
    d = np.diff(y)

    def fit(p, q):
        rows = np.column_stack([y[q:-1], *(d[q - k : len(d) - k] for k in range(1, p + 1)), *(np.arange(1.0, len(d) - q + 1) ** k for k in range(trend))])
        size = np.linalg.norm(rows, axis=0)
        unit = rows / np.where(size > 0, size, 1.0)
        beta = np.linalg.lstsq(unit, d[q:], rcond=None)[0]
        res = d[q:] - unit @ beta
        s2 = res @ res / (len(res) - rows.shape[1])
        if s2 <= 0:
            raise Refused("no variance is left")
        t = beta[0] / math.sqrt(s2 * np.linalg.pinv(unit.T @ unit)[0, 0])
        return len(res) * math.log(res @ res / len(res)) + 2 * rows.shape[1], t

    p = min(range(most + 1), key=lambda k: (fit(k, most)[0], k))
    return float(fit(p, p)[1]), p


#: Response surfaces of MacKinnon (1994) with a constant, for one variable and for two: lowest, split and highest statistic, coefficients below and above the split.
SURFACES = {
    1: (-18.83, -1.61, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-18.86, -2.62, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def unit_root_p(t: float, variables: int = 1) -> float:
    low, split, high, below, above = SURFACES[variables]
    if t > high or t < low:
        return float(t > high)
    at = sum(c * t**k for k, c in enumerate(below if t <= split else above))
    return 0.5 * math.erfc(-at / math.sqrt(2))


#: Critical points of the level test (Kwiatkowski et al. 1992) and their levels.
KPSS_POINTS, KPSS_LEVELS = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def kpss_p(statistic: float) -> float:
    """Between the published levels; beyond them the outermost."""
    return float(np.interp(statistic, KPSS_POINTS, KPSS_LEVELS))


#: 1, 5 and 10 in 100 of the test of one break in the mean.
BREAK_POINTS, BREAK_LEVELS = (-5.27644, -4.81067, -4.56618), (0.01, 0.05, 0.10)
BREAK_CRITICAL = BREAK_POINTS[1]


def break_p(statistic: float) -> float:
    """Between the known levels; beyond them the outermost."""
    return float(np.interp(statistic, BREAK_POINTS, BREAK_LEVELS))


def zivot_andrews(y: np.ndarray, trim: float = 0.15) -> tuple[float, int]:
    """The least unit-root statistic over all places of one break in the mean but for the outer parts, and the last position before the break (Zivot and Andrews 1992)."""
    n, lags = len(y), unit_root(y, trend=2)[1]
    cut, d = int(n * trim), np.diff(y)
    fixed = np.column_stack([np.ones(n - 1 - lags), np.arange(lags + 2.0, n + 1), y[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))])
    at, best = np.arange(lags + 1, n), (math.inf, cut)
    for b in range(max(cut, lags + 2), n - cut):
        rows = np.column_stack([fixed, at > b])
        beta, _, rank, _ = np.linalg.lstsq(rows / np.linalg.norm(rows, axis=0), d[lags:], rcond=None)
        if rank < rows.shape[1]:
            continue
        unit = rows / np.linalg.norm(rows, axis=0)
        res = d[lags:] - unit @ beta
        t = beta[2] / math.sqrt(res @ res / (len(res) - rows.shape[1]) * np.linalg.inv(unit.T @ unit)[2, 2])
        best = min(best, (float(t), b))
    return best


def kpss(y: np.ndarray) -> float:
    """Level stationarity statistic with a Bartlett kernel and the automatic bandwidth of Hobijn et al. (1998)."""
    n, e = len(y), y - y.mean()
    cap = int(n ** (2 / 9))
    cov = lambda k: float(e[k:] @ e[: n - k])
    s0, s1 = cov(0) / n, 0.0
    for k in range(1, cap + 1):
        c = cov(k) / (n / 2)
        s0, s1 = s0 + c, s1 + k * c
    lag = int(min(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3), n - 1)) if s0 else 0
    long = (cov(0) + 2 * sum(cov(k) * (1 - k / (lag + 1)) for k in range(1, lag + 1))) / n
    return float((np.cumsum(e) ** 2).sum() / n**2 / long) if long > 0 else math.inf


def diagnosis(y: np.ndarray, level: float = 0.05) -> tuple[str, bool]:
    """I(0), I(1) or ambiguous, by the unit-root test, the stationarity test and the same of first differences, all at one level; and whether the break test, which long series get, could not be computed. A break test that rejects a unit root takes I(1) back."""
    if np.ptp(y) == 0:
        return "ambiguous", False
    unverified, breaks = False, False
    try:
        verdict = lambda v: (unit_root_p(unit_root(v)[0]) < level, kpss_p(kpss(v)) < level)
        now = verdict(y)
        if len(y) >= 80:
            try:
                t = zivot_andrews(y)[0]
                unverified, breaks = not math.isfinite(t), break_p(t) < level if level not in BREAK_LEVELS else t < BREAK_POINTS[BREAK_LEVELS.index(level)]
            except (Refused, np.linalg.LinAlgError, ZeroDivisionError, ValueError):
                unverified = True
        if now == (True, False):
            return "I(0)", unverified
        if now == (False, True) and len(y) > 20 and not breaks and verdict(np.diff(y)) == (True, False):
            return "I(1)", unverified
    except Refused:
        pass
    return "ambiguous", unverified


def integration_order(y: np.ndarray, level: float = 0.05) -> str:
    return diagnosis(y, level)[0]
