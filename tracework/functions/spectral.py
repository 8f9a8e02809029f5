"""Small NumPy helpers that run on one bounded array inside a task."""
from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(n)


def one_sided(power: np.ndarray, n: int, keep_last: bool | None = None) -> np.ndarray:
    """Double the interior bins of a half spectrum (the last bin stays single for even n)."""
    single_last = (n % 2 == 0) if keep_last is None else keep_last
    out = power.copy()
    stop = len(out) - 1 if single_last else len(out)
    out[..., 1:stop] *= 2
    return out


def psd_segment(x: np.ndarray, fs: float) -> np.ndarray:
    """Hann periodogram of one mean-removed segment, density scaling, one-sided."""
    n = len(x)
    w = hann(n)
    p = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (fs * np.sum(w * w))
    return one_sided(p, n)


def segment_starts(n: int, size: int, step: int) -> range:
    return range(0, n - size + 1, step)


def welch(x: np.ndarray, fs: float, nperseg: int = 256) -> np.ndarray:
    size = min(nperseg, len(x))
    step = size - size // 2
    return np.mean([psd_segment(x[s:s + size], fs) for s in segment_starts(len(x), size, step)], axis=0)


def stft_mean(x: np.ndarray, nperseg: int = 256) -> float:
    """Mean magnitude of the zero-padded short-time spectrum, window-sum scaling."""
    size = min(nperseg, len(x))
    step = size - size // 2
    half = size // 2
    padded = np.concatenate([np.zeros(half), x, np.zeros(half)])
    extra = (-(len(padded) - size) % step) % size
    padded = np.concatenate([padded, np.zeros(extra)])
    w = hann(size)
    frames = np.stack([padded[s:s + size] * w for s in segment_starts(len(padded), size, step)])
    return float(np.abs(np.fft.rfft(frames, axis=1)).mean() / w.sum())


#: Wavelets by scale and transforms by length; plain dictionaries, as functions travel to the tasks by value.
_WAVELETS: dict[tuple, np.ndarray] = {}
_SHORT: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
SHORT_POINTS = 32


def _wavelet(scale: int, bandwidth: float, centre: float) -> np.ndarray:
    """Integrated complex Morlet wavelet of one scale, reversed."""
    known = _WAVELETS.get((scale, bandwidth, centre))
    if known is not None:
        return known
    t = np.linspace(-8.0, 8.0, 1024)
    psi = np.exp(2j * np.pi * centre * t - t * t / bandwidth) / np.sqrt(np.pi * bandwidth)
    area = np.cumsum(psi) * (t[1] - t[0])
    pick = (np.arange(scale * 16 + 1) / (scale * (t[1] - t[0]))).astype(int)
    return _WAVELETS.setdefault((scale, bandwidth, centre), area[pick[pick < len(area)]][::-1])


def _coefficients(x: np.ndarray, scale: int, bandwidth: float, centre: float) -> np.ndarray:
    coef = -np.sqrt(scale) * np.diff(np.convolve(x, _wavelet(scale, bandwidth, centre)))
    cut = (len(coef) - len(x)) / 2
    return coef[int(np.floor(cut)):len(coef) - int(np.ceil(cut))] if cut > 0 else coef


def _short(n: int, scales: range, bandwidth: float, centre: float) -> tuple[np.ndarray, np.ndarray]:
    """The transform of ``n`` samples as a matrix, and the first row of each scale."""
    known = _SHORT.get((n, scales, bandwidth, centre))
    if known is not None:
        return known
    parts = [np.stack([_coefficients(e, s, bandwidth, centre) for e in np.eye(n)], axis=1) for s in scales]
    return _SHORT.setdefault((n, scales, bandwidth, centre), (np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])))


def morlet_mean(x: np.ndarray, scales: range = range(1, 64), every: int = 10, bandwidth: float = 1.5, centre: float = 1.0) -> float:
    """Mean magnitude of the complex Morlet transform of every tenth sample."""
    x = x[::every]
    if len(x) <= SHORT_POINTS:  # short series: one product with a matrix that is made once per length
        matrix, first = _short(len(x), scales, bandwidth, centre)
        size = np.abs(matrix @ x)
        return float((np.add.reduceat(size, first[:-1]) / np.diff(first)).sum() / len(scales))
    return float(sum(np.abs(_coefficients(x, s, bandwidth, centre)).mean() for s in scales) / len(scales))


def resample(x: np.ndarray, num: int) -> np.ndarray:
    """Band-limited resampling: crop or pad the spectrum."""
    n = len(x)
    spec = np.fft.rfft(x)
    keep = min(n, num)
    out = np.zeros(num // 2 + 1, dtype=complex)
    out[:keep // 2 + 1] = spec[:keep // 2 + 1]
    if keep % 2 == 0 and n != num:
        out[keep // 2] *= 2.0 if num < n else 0.5
    return np.fft.irfft(out, num) * (num / n)
