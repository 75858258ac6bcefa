"""Series transformers that need linear algebra or recursions: NumPy over Arrow batches.

Each takes a matrix of series of one length, a row for each, and gives a matrix.
``transform`` applies one to a column of series of any lengths: a null series stays
null, an empty one gives an empty result, and a batch's series are grouped by length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Matrix = Callable[[np.ndarray], np.ndarray]


def transform(df: DataFrame, f: Matrix, column: str = "s", name: str = "v", rows: int = 1024) -> DataFrame:
    """df's other columns with f of each series, an array of doubles."""
    others = [c for c in df.columns if c != column]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                series = b.column(len(others)).to_pylist()
                out: list = [None] * len(series)
                by: dict[int, list[int]] = {}
                for i, s in enumerate(series):
                    if s is not None:
                        by.setdefault(len(s), []).append(i)
                for n, at in by.items():
                    found = f(np.array([[np.nan if x is None else x for x in series[i]] for i in at], float)) if n else np.zeros((len(at), 0))
                    for i, v in zip(at, found.tolist()):
                        out[i] = v
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(out, pa.list_(pa.float64()))], [*others, name])

    return df.select(*others, column).mapInArrow(each, f"{fields}{', ' if others else ''}`{name}` array<double>")


def padded(x: np.ndarray) -> np.ndarray:
    """To a power of two, with the series' mean."""
    n = x.shape[1]
    size = 1 << max(0, (n - 1).bit_length())
    return np.concatenate((x, np.repeat(x.mean(1, keepdims=True), size - n, 1)), 1)


def fourier(x: np.ndarray, pad: bool = False) -> np.ndarray:
    """Real and imaginary parts in turn, of the first half of the coefficients."""
    x = padded(x) if pad else x
    c = np.fft.fft(x, axis=1)[:, : x.shape[1] // 2]
    return np.stack((c.real, c.imag), 2).reshape(len(x), -1)


def power_spectrum(x: np.ndarray, log: bool = False) -> np.ndarray:
    """Magnitudes of the first half of the coefficients."""
    size = np.abs(np.fft.fft(x, axis=1)[:, : x.shape[1] // 2])
    return np.log(np.maximum(size, 1e-300)) if log else size


def power_cepstrum(x: np.ndarray) -> np.ndarray:
    """Squared magnitudes of the inverse transform of the log power spectrum; first half."""
    spectrum = np.log(np.maximum(np.abs(np.fft.fft(padded(x), axis=1)) ** 2, 1e-300))
    return (np.abs(np.fft.ifft(spectrum, axis=1)) ** 2)[:, : spectrum.shape[1] // 2]


def cosine(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return x @ np.cos(np.pi / n * np.outer(np.arange(n) + 0.5, np.arange(n)))


def sine(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return x @ np.sin(np.pi / n * np.outer(np.arange(n) + 0.5, np.arange(n)))


def hilbert(x: np.ndarray) -> np.ndarray:
    d = np.arange(x.shape[1])[None, :] - np.arange(x.shape[1])[:, None]
    return x @ np.where(d == 0, 0.0, 1.0 / np.where(d == 0, 1, d))


def frames(x: np.ndarray, size: int, step: int) -> np.ndarray:
    """(rows, frames, size): windows of a size, step apart."""
    return np.lib.stride_tricks.sliding_window_view(x, min(size, x.shape[1]), 1)[:, ::step]


def spectrogram(x: np.ndarray, bins: int = 256, window: int = 75, overlap: int = 70) -> np.ndarray:
    """Magnitudes of windowed transforms, frame by frame, one after the other; windows of half the series at most."""
    window = max(1, min(window, x.shape[1] // 2))
    overlap = min(overlap, window - 1)
    bins = min(bins, 1 << max(1, (x.shape[1] // 2).bit_length()))
    f = frames(x, window, window - overlap) * np.hanning(window)
    return np.abs(np.fft.rfft(f, bins, 2)).reshape(len(x), -1)


def mel_filters(filters: int, bins: int, rate: float, top: float) -> np.ndarray:
    """Triangles of equal width on the mel scale."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), filters + 2) / 2595) - 1)
    f = np.arange(bins) * rate / (2 * (bins - 1))
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None)


def mfcc(x: np.ndarray, filters: int = 65, kept: int = 13, bins: int = 512, rate: float = 16000.0, top: float = 2000.0, window: int = 75, overlap: int = 70) -> np.ndarray:
    """Cosine transform of log mel energies, frame by frame."""
    window = max(1, min(window, x.shape[1] // 2))
    f = frames(x, window, max(1, window - min(overlap, window - 1))) * np.hanning(window)
    power = np.abs(np.fft.rfft(f, bins, 2)) ** 2 / bins
    energy = np.log(np.maximum(power @ mel_filters(filters, power.shape[2], rate, top).T, 1e-12))
    n = energy.shape[2]
    return (energy @ np.cos(np.pi / n * np.outer(np.arange(n) + 0.5, np.arange(kept)))).reshape(len(x), -1)


def audio_features(x: np.ndarray) -> np.ndarray:
    """Spectral centroid, spread, flatness (geometric over arithmetic mean), skewness, kurtosis, and zero-crossing rate; 0 without power."""
    size = np.abs(np.fft.rfft(x, axis=1))
    total = size.sum(1, keepdims=True)
    share = np.divide(size, total, out=np.zeros_like(size), where=total > 0)
    f = np.arange(size.shape[1])
    centroid = share @ f
    off = f - centroid[:, None]
    spread = np.sqrt((share * off**2).sum(1))
    safe = np.where(spread > 0, spread, 1)
    flat = np.divide(np.exp(np.log(np.maximum(size, 1e-300)).mean(1)), size.mean(1), out=np.zeros(len(x)), where=size.mean(1) > 0)
    crossings = (np.diff(x >= 0, axis=1)).mean(1) if x.shape[1] > 1 else np.zeros(len(x))
    return np.stack((centroid, spread, flat, (share * off**3).sum(1) / safe**3, (share * off**4).sum(1) / safe**4, crossings), 1)


def autocorrelations(x: np.ndarray, lags: int = 100, end: int = 4) -> np.ndarray:
    """At lags 1 to lags (the length less end at most), by the overlapping parts' moments; 1 if neither part varies, 0 if one does not."""
    n = x.shape[1]
    out = np.zeros((len(x), max(0, min(lags, n - end))))
    for k in range(1, out.shape[1] + 1):
        a, b = x[:, :-k], x[:, k:]
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        va, vb, c = (a * a).mean(1), (b * b).mean(1), (a * b).mean(1)
        out[:, k - 1] = np.where((va > 0) & (vb > 0), c / np.sqrt(np.where((va > 0) & (vb > 0), va * vb, 1)), ((va == 0) & (vb == 0)).astype(float))
    return out


def _levinson(acf: np.ndarray) -> np.ndarray:
    """(rows, p, p): column k has the coefficients of the autoregression of order k + 1."""
    p = acf.shape[1]
    phi = np.zeros((len(acf), p, p))
    if p:
        phi[:, 0, 0] = acf[:, 0]
    for k in range(1, p):
        before, lagged = phi[:, :k, k - 1], acf[:, k - 1 :: -1][:, :k]
        over = acf[:, k] - (before * lagged).sum(1)
        under = 1 - (before[:, ::-1] * lagged).sum(1)
        phi[:, k, k] = np.divide(over, under, out=np.zeros(len(acf)), where=under != 0)
        phi[:, :k, k] = before - phi[:, [k], k] * before[:, ::-1]
    return phi


def partial_autocorrelations(x: np.ndarray, lags: int = 100, end: int = 4) -> np.ndarray:
    phi = _levinson(autocorrelations(x, lags, end))
    out = phi[:, np.arange(phi.shape[1]), np.arange(phi.shape[1])]
    return np.where(np.isfinite(out), out, 0.0)


def both_autocorrelations(x: np.ndarray, lags: int = 100, end: int = 4) -> np.ndarray:
    return np.concatenate((autocorrelations(x, lags, end), partial_autocorrelations(x, lags, end)), 1)


def autoregression(x: np.ndarray, lags: int = 25, by_aic: bool = True) -> np.ndarray:
    """Coefficients of the order of least AIC (or of all lags), 0 beyond it."""
    n = x.shape[1]
    phi = _levinson(autocorrelations(x, min(lags, n // 4), 0))
    p = phi.shape[2]
    if not p:
        return np.zeros((len(x), 0))
    best = np.full(len(x), p - 1)
    if by_aic:
        centred = x - x.mean(1, keepdims=True)
        score = np.empty((len(x), p))
        for k in range(p):
            past = np.lib.stride_tricks.sliding_window_view(centred, k + 1, 1)[:, :-1, ::-1]
            off = centred[:, k + 1 :] - (past * phi[:, None, : k + 1, k]).sum(2)
            score[:, k] = n * np.log(np.maximum((off**2).mean(1), 1e-300)) + 2 * (k + 1)
        best = score.argmin(1)
    out = phi[np.arange(len(x)), :, best]
    return np.where(np.isfinite(out), out, 0.0)


def windows(x: np.ndarray, size: int, scaled: bool = True) -> np.ndarray:
    """(rows, windows, size), z-normalised; a window without spread is zero."""
    w = np.lib.stride_tricks.sliding_window_view(x, size, 1)
    if not scaled:
        return w
    w = w - w.mean(2, keepdims=True)
    sd = w.std(2, keepdims=True)
    return np.divide(w, sd, out=np.zeros(w.shape), where=sd > 1e-12)


def matrix_profile(x: np.ndarray, size: int = 10) -> np.ndarray:
    """Squared distance of each window to the nearest over 1.5 sizes away, then that window's place; without one, the largest double and -1."""
    n = x.shape[1] - size + 1
    if n < 1:
        return np.zeros((len(x), 0))
    away = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]) > 1.5 * size
    out = np.empty((len(x), 2 * n))
    for k, w in enumerate(windows(x, size)):
        norm = (w * w).sum(1)
        d = np.where(away, np.maximum(norm[:, None] + norm[None, :] - 2 * w @ w.T, 0.0), np.inf)
        at = d.argmin(1)
        least = d[np.arange(n), at]
        out[k, :n] = np.where(np.isfinite(least), least, np.finfo(float).max)
        out[k, n:] = np.where(np.isfinite(least), at, -1)
    return out


def parts(n: int, intervals: int) -> list[tuple[int, int]]:
    """Bounds of intervals: each takes a whole share of what is left."""
    out, at = [], 0
    for k in range(intervals, 0, -1):
        size = (n - at) // k
        out.append((at, at + size))
        at += size
    return out


def slopes(x: np.ndarray, intervals: int = 8) -> np.ndarray:
    """Total-least-squares gradients of the intervals, positions from 1; 0 where the covariance is."""
    out = np.zeros((len(x), intervals))
    for k, (a, b) in enumerate(parts(x.shape[1], intervals)):
        if b > a:
            y, t = x[:, a:b] - x[:, a:b].mean(1, keepdims=True), np.arange(b - a) - (b - a - 1) / 2
            w, r = (y * y).sum(1) - (t * t).sum(), 2 * (y * t).sum(1)
            out[:, k] = np.where(r == 0, 0.0, (w + np.sqrt(w * w + r * r)) / np.where(r == 0, 1, r))
    return out


def gradient_histograms(x: np.ndarray, intervals: int = 2, bins: int = 8, scale: float = 0.1) -> np.ndarray:
    """For each interval, how many of its gradients' angles fall in each of the bins from -90 to 90 degrees; a bin holds its upper bound."""
    out = np.zeros((len(x), intervals, bins))
    upper = -90 + 180 / bins * np.arange(1, bins + 1)
    for k, (a, b) in enumerate(parts(x.shape[1], intervals)):
        if b > a:
            t = np.concatenate((x[:, [a]], x[:, a:b], x[:, [b - 1]]), 1)
            angle = np.degrees(np.arctan(scale * 0.5 * (t[:, 2:] - t[:, :-2])))
            at = np.minimum(np.searchsorted(upper, angle), bins - 1)
            for j in range(bins):
                out[:, k, j] = (at == j).sum(1)
    return out.reshape(len(x), -1)


def haar(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Approximations, then details from the last level to the first."""
    details, now = [], x
    for _ in range(levels):
        if now.shape[1] == 1:
            details.append(now)
            continue
        even, odd = now[:, 0 : now.shape[1] // 2 * 2 : 2], now[:, 1::2]
        details.append((even - odd) / math.sqrt(2))
        now = (even + odd) / math.sqrt(2)
    return np.concatenate([now, *details[::-1]], 1)


def subsequences(x: np.ndarray, size: int = 30) -> np.ndarray:
    """For each point, the window of a size around it, of the z-normalised series with its ends repeated; one after the other."""
    sd = x.std(1, keepdims=True)
    z = np.divide(x - x.mean(1, keepdims=True), sd, out=np.zeros_like(x), where=sd > 1e-12)
    z = np.pad(z, ((0, 0), (size // 2, size - size // 2 - 1)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(z, size, 1).reshape(len(x), -1)


class Rocket:
    """Random convolution kernels: of length 7, 9 or 11, centred normal weights, uniform bias, exponential dilation, padding by halves."""

    def __init__(self, kernels: int, length: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.kernels = []
        for _ in range(kernels):
            size = int(rng.choice([k for k in (7, 9, 11) if k <= max(7, length)]))
            w = rng.normal(size=size)
            dilation = int(2 ** rng.uniform(0, math.log2(max(1.0, (length - 1) / (size - 1)))))
            pad = (size - 1) * dilation // 2 if rng.integers(2) else 0
            self.kernels.append((w - w.mean(), rng.uniform(-1, 1), dilation, pad))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """For each kernel, the share of positive values and the maximum."""
        out = np.zeros((len(x), 2 * len(self.kernels)))
        for k, (w, bias, dilation, pad) in enumerate(self.kernels):
            reach = (len(w) - 1) * dilation
            p = np.pad(x, ((0, 0), (pad, pad)))
            n = p.shape[1] - reach
            if n < 1:
                continue
            s = bias + sum(w[j] * p[:, j * dilation : j * dilation + n] for j in range(len(w)))
            out[:, 2 * k], out[:, 2 * k + 1] = (s > 0).mean(1), s.max(1)
        return out


def _stretch(hit: np.ndarray) -> int:
    """The longest distance between neighbouring breaks, the first at 0 and the last point counted as one."""
    breaks = np.flatnonzero(~hit)
    ends = np.unique(np.append(breaks, len(hit) - 1))
    return int(np.diff(np.concatenate(([0], ends))).max()) if len(ends) else 0


def _acf(x: np.ndarray) -> tuple[np.ndarray, int]:
    n = len(x)
    f = np.fft.fft(x - x.mean(), 1 << max(1, (n - 1).bit_length()))
    ac = np.fft.ifft(np.abs(f) ** 2).real[:n]
    ac = ac / ac[0] if ac[0] else np.ones(n)
    below = np.flatnonzero(ac[1:] <= 0)
    return ac, int(below[0]) + 1 if len(below) else n


def _mode(x: np.ndarray, bins: int) -> float:
    lo, hi = x.min(), x.max()
    if lo == hi:
        return 0.0
    width = (hi - lo) / bins
    count = np.bincount(np.minimum(((x - lo) / width).astype(int), bins - 1), minlength=bins)
    return float((lo + width * (np.flatnonzero(count == count.max()) + 0.5)).mean())


def _outliers(x: np.ndarray) -> float:
    """The median of the rescaled median places of what is beyond rising thresholds."""
    n, top = len(x), x.max()
    if top < 0.01:
        return 0.0
    found = []
    for t in np.arange(int(top / 0.01) + 1) * 0.01:
        at = np.flatnonzero(x >= t)
        if len(at) < 2 or (len(at) - 1) * 100 / n <= 2:
            break
        found.append(np.median(at) / (n / 2) - 1)
    return float(np.median(found)) if found else 0.0


def _terciles(x: np.ndarray) -> np.ndarray:
    rank = np.empty(len(x), int)
    rank[np.argsort(x, kind="stable")] = np.arange(len(x))
    return np.minimum(rank * 3 // max(len(x), 1), 2)


def _welch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(1, (len(x) - 1).bit_length())
    power = np.abs(np.fft.rfft(x - x.mean(), size)) ** 2 / len(x)
    power[1:-1] *= 2
    return 2 * np.pi * np.arange(len(power)) / size, power / (2 * np.pi)


def _fluctuation(x: np.ndarray, detrend: bool) -> float:
    """The share of scales on the first of two lines that fit log fluctuation against log scale best."""
    y = np.cumsum(x - x.mean())
    scales = np.unique(np.round(np.exp(np.linspace(math.log(5), math.log(max(6, len(x) // 2)), 50))).astype(int))
    if len(scales) < 12 or len(x) < 12:
        return 0.0
    size = []
    for t in scales:
        w = y[: len(y) // t * t].reshape(-1, t)
        u = np.arange(t) - (t - 1) / 2
        off = w - w.mean(1, keepdims=True)
        off = off - (off @ u / (u @ u))[:, None] * u
        size.append(np.sqrt((off**2).mean()) if detrend else np.sqrt(((off.max(1) - off.min(1)) ** 2).mean()))
    a, b = np.log(scales), np.log(np.maximum(size, 1e-300))
    fit = lambda p, q: float(np.linalg.norm(q - np.polyval(np.polyfit(p, q, 1), p)))
    cost = [fit(a[:k], b[:k]) + fit(a[k - 1 :], b[k - 1 :]) for k in range(6, len(a) - 5)]
    return (int(np.argmin(cost)) + 6) / len(a)


def catch22_of(x: np.ndarray) -> list[float]:
    """The 22 canonical features of one series (Lubba et al. 2019), in their usual order."""
    n = len(x)
    if n < 4 or not np.isfinite(x).all() or x.min() == x.max():
        return [0.0] * 22
    ac, zero = _acf(x)
    d = np.diff(x)
    w, power = _welch(x)
    low = np.flatnonzero((ac[1:-1] < ac[:-2]) & (ac[1:-1] < ac[2:]))
    e = np.flatnonzero(ac[1:] < 1 / math.e)
    ahead = np.lib.stride_tricks.sliding_window_view(x, 3)[:-1].mean(1)
    grid = np.linspace(x.min() - 0.1, x.max() + 0.1, 6)
    joint = np.histogram2d(x[:-2], x[2:], [grid, grid])[0] / (n - 2)
    px, py = joint.sum(1), joint.sum(0)
    known = joint > 0
    mi = float((joint[known] * np.log(joint[known] / np.outer(px, py)[known])).sum())
    auto = [-0.5 * math.log(max(1e-12, 1 - np.corrcoef(x[:-k], x[k:])[0, 1] ** 2)) if x[:-k].std() and x[k:].std() else 0.0 for k in range(1, min(40, n // 2) + 1)]
    drop = [k for k in range(1, len(auto) - 1) if auto[k] < auto[k - 1] and auto[k] < auto[k + 1]]
    t = _terciles(x)
    pairs = np.bincount(t[:-1] * 3 + t[1:], minlength=9) / (n - 1)
    entropy = -float((pairs[pairs > 0] * np.log(pairs[pairs > 0])).sum())
    tau = max(1, min(zero, n // 10))
    step = np.sqrt(np.diff(x[:-tau]) ** 2 + np.diff(x[tau:]) ** 2)
    bins = max(1, math.ceil((step.max() - step.min()) / (3.5 * step.std() / len(step) ** (1 / 3)))) if len(step) and step.std() > 0.001 else 1
    count, edges = np.histogram(step, min(bins, 100)) if len(step) else (np.zeros(1), np.array([0.0, 1.0]))
    middle, mean = (edges[:-1] + edges[1:]) / 2, step.mean() if len(step) and step.mean() > 0 else 1.0
    embed = float(np.abs(count / max(1, len(step)) - np.exp(-middle / mean) / mean).mean())
    coarse = _terciles(x[::zero]) if zero < n else np.zeros(0, int)
    moves = np.bincount(coarse[:-1] * 3 + coarse[1:], minlength=9).reshape(3, 3) / max(1, len(coarse) - 1) if len(coarse) > 1 else np.zeros((3, 3))
    knots = np.linspace(0, n - 1, 5)
    hats = np.clip(1 - np.abs(np.arange(n)[:, None] - knots[None, :]) / (knots[1] or 1), 0, None)
    flat = x - hats @ np.linalg.lstsq(hats, x, rcond=None)[0]
    fac, _ = _acf(flat) if flat.std() else (np.ones(n), n)
    period, trough = 0, 1.0
    for k in range(1, n - 1):
        if fac[k] <= fac[k - 1] and fac[k] < fac[k + 1]:
            trough = fac[k]
        elif fac[k] >= fac[k - 1] and fac[k] > fac[k + 1] and fac[k] >= 0 and fac[k] - trough >= 0.01 and trough < 1.0:
            period = k
            break
    running = np.cumsum(power)
    return [
        _mode(x, 5), _mode(x, 10), float(_stretch(x > x.mean())), _outliers(x), _outliers(-x), float(e[0] + 1 if len(e) else n), float(low[0] + 1 if len(low) else n),
        float(power[: len(power) // 5].sum() * (w[1] if len(w) > 1 else 0)), float(w[np.searchsorted(running, running[-1] / 2, "right").clip(0, len(w) - 1)]),
        float(np.std(x[3:] - ahead, ddof=1)) if n - 3 >= 3 else 0.0, float((d**3).mean()), mi, float(drop[0]) if drop else float(len(auto)), float((np.abs(d) * 1000 > 40).mean()), float(_stretch(d < 0)), entropy,
        _acf(d)[1] / zero if d.std() else 0.0, embed, _fluctuation(x, True), _fluctuation(x, False), float(np.trace(np.cov(moves))), float(period),
    ]


def catch22(x: np.ndarray) -> np.ndarray:
    return np.array([catch22_of(row) for row in x]).reshape(len(x), 22)


def summary(x: np.ndarray) -> np.ndarray:
    """Mean, population variance, skewness, kurtosis (not in excess of 3), slope, minimum, maximum; 0 for moments without spread."""
    m, v = x.mean(1), x.var(1)
    sd = np.sqrt(np.where(v > 0, v, 1))
    z = (x - m[:, None]) / sd[:, None]
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    slope = x @ t / max((t * t).sum(), 1e-300) if x.shape[1] > 1 else np.zeros(len(x))
    return np.stack((m, v, np.where(v > 0, (z**3).mean(1), 0), np.where(v > 0, (z**4).mean(1), 0), slope, x.min(1), x.max(1)), 1)
