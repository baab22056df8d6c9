"""Signal arithmetic in numpy: spectra, filters, wavelets, order filters, peaks, resampling."""

from __future__ import annotations

import bisect
import math
from functools import lru_cache

import numpy as np

#: Decomposition low-pass of the symlet with four vanishing moments.
SYM4 = (
    -0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161,
    0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427,
)


# --- filters -----------------------------------------------------------------


def _sinc_lowpass(taps: int, cutoff: float, rate: float) -> np.ndarray:
    n = np.arange(taps) - (taps - 1) / 2
    return np.sinc(2 * cutoff / rate * n) * 2 * cutoff / rate * np.hamming(taps)


def fir_lowpass(taps: int = 101, cutoff: float = 1000.0, rate: float = 16_000.0) -> np.ndarray:
    """Windowed-sinc low-pass (Hamming) with gain one at zero frequency."""
    h = _sinc_lowpass(taps, cutoff, rate)
    return h / h.sum()


def fir_bandpass(taps: int = 101, low: float = 5000.0, high: float = 6000.0, rate: float = 16_000.0) -> np.ndarray:
    """Windowed-sinc band-pass (Hamming) with gain one in the middle of the band."""
    h = _sinc_lowpass(taps, high, rate) - _sinc_lowpass(taps, low, rate)
    n = np.arange(taps) - (taps - 1) / 2
    return h / (h * np.cos(np.pi * (low + high) / rate * n)).sum()


def fir_apply(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Causal filtering from rest."""
    n = len(x) + len(taps) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[: len(x)]


def butterworth_gain(freqs: np.ndarray, low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Squared magnitude of a digital Butterworth band-pass (bilinear transform, prewarped edges).

    This is also the response of the filter run forward and backward.
    """
    warp = lambda f: np.tan(np.pi * np.clip(f, 1e-9, rate / 2 * (1 - 1e-9)) / rate)
    a, b, w = warp(low), warp(high), warp(freqs)
    return 1.0 / (1.0 + ((w * w - a * b) / (w * (b - a))) ** (2 * order))


def bandpass_zero_phase(x: np.ndarray, rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Forward-backward Butterworth band-pass, applied as its zero-phase response to the oddly extended signal."""
    x = np.asarray(x, float)
    pad = min(len(x) - 1, int(4 * rate / (high - low)))
    if pad > 0:
        head, tail = 2 * x[0] - x[pad:0:-1], 2 * x[-1] - x[-2 : -pad - 2 : -1]
        ext = np.concatenate([head, x, tail])
    else:
        ext = x
    size = 1 << (2 * len(ext) - 1).bit_length()
    gain = butterworth_gain(np.fft.rfftfreq(size, 1 / rate), low, high, rate, order)
    y = np.fft.irfft(np.fft.rfft(ext, size) * gain, size)
    return y[pad : pad + len(x)]


# --- spectra -----------------------------------------------------------------


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frame(x: np.ndarray, width: int, hop: int) -> np.ndarray:
    """Overlapping frames as rows of a view; none where the signal is shorter."""
    if len(x) < width:
        return np.zeros((0, width))
    return np.lib.stride_tricks.sliding_window_view(x, width)[::hop]


def stft_density(x: np.ndarray, width: int = 400, overlap: int = 240, nfft: int = 512) -> np.ndarray:
    """Spectrum-scaled STFT: half a window of zeros on both sides, padded to whole hops."""
    hop = width - overlap
    x = np.concatenate([np.zeros(width // 2), np.asarray(x, float), np.zeros(width // 2)])
    x = np.concatenate([x, np.zeros(-(len(x) - width) % hop)])
    w = hann(width)
    return np.fft.rfft(frame(x, width, hop) * w, nfft, axis=1).T / w.sum()


def stft_centred(x: np.ndarray, nfft: int = 512, hop: int = 160, width: int = 400) -> np.ndarray:
    """STFT of frames centred on multiples of the hop, the window centred in the transform."""
    w = np.zeros(nfft)
    at = (nfft - width) // 2
    w[at : at + width] = hann(width)
    x = np.pad(np.asarray(x, float), nfft // 2)
    return np.fft.rfft(frame(x, nfft, hop) * w, axis=1).T


def stft_plain(x: np.ndarray, width: int, overlap: int) -> np.ndarray:
    """STFT of the whole frames inside the signal."""
    w = hann(width)
    return np.fft.rfft(frame(np.asarray(x, float), width, width - overlap) * w, axis=1).T / w.sum()


@lru_cache(8)
def dct_matrix(n: int, keep: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, m = np.arange(keep)[:, None], np.arange(n)[None, :]
    out = np.cos(np.pi * k * (2 * m + 1) / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


@lru_cache(8)
def linear_filterbank(filters: int, nfft: int, rate: float) -> np.ndarray:
    """Triangles with evenly spaced corners from zero to half the rate."""
    hz = np.fft.rfftfreq(nfft, 1 / rate)
    edge = np.linspace(0, rate / 2, filters + 2)
    rise = (hz[None, :] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - hz[None, :]) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(rise, fall))


def slopes(rows: np.ndarray, order: int = 1, reach: int = 4) -> np.ndarray:
    """The ``order``-th derivative of the least-squares polynomial of degree ``order`` over ``reach`` frames on both sides.

    Such a derivative is the same all along one polynomial, so the frames at the
    edges, which lack neighbours, take the value of the nearest whole fit.
    """
    width = 2 * reach + 1
    if rows.shape[1] < width:
        raise ValueError(f"slopes need at least {width} frames")
    at = np.arange(-reach, reach + 1)
    taps = np.linalg.pinv(np.vander(at, order + 1, increasing=True))[order] * math.factorial(order)
    inner = np.lib.stride_tricks.sliding_window_view(rows, width, axis=1) @ taps
    return np.pad(inner, ((0, 0), (reach, reach)), mode="edge")


# --- wavelets ----------------------------------------------------------------


def dwt(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level with half-sample symmetric extension: (approximation, detail) of floor((n + taps - 1) / 2)."""
    taps = len(low)
    high = low[::-1] * np.where(np.arange(taps) % 2, 1.0, -1.0)
    ext = np.pad(x, taps - 1, mode="symmetric")
    return tuple(np.convolve(ext, f, "valid")[1::2] for f in (low, high))


def packet_energies(x: np.ndarray, level: int, low: tuple[float, ...] = SYM4) -> np.ndarray:
    """Squared wavelet-packet coefficients at ``level``, one row per band, bands by rising frequency.

    Splitting a band whose spectrum came out mirrored yields its halves in
    reverse, which is the case for every second band.
    """
    taps = np.array(low)
    bands = [np.asarray(x, float)]
    for _ in range(level):
        split = [dwt(b, taps) for b in bands]
        bands = [half for i, pair in enumerate(split) for half in (pair if i % 2 == 0 else pair[::-1])]
    return np.stack(bands) ** 2


def haar_detail(x: np.ndarray) -> np.ndarray:
    """Magnitude of the undecimated, normalised Haar detail, periodic at the end."""
    return np.abs(x - np.roll(x, -1)) / 2


# --- order filters -----------------------------------------------------------


def moving_maximum(x: np.ndarray, size: int) -> np.ndarray:
    """Maximum of the ``size`` samples around each, mirrored at the edges (``size`` odd)."""
    out = np.pad(x, size // 2, mode="symmetric")
    have = 1
    while have * 2 <= size:
        out = np.maximum(out[:-have], out[have:])
        have *= 2
    if have < size:
        out = np.maximum(out[: len(out) - (size - have)], out[size - have :])
    return out


def moving_median(x: np.ndarray, size: int) -> np.ndarray:
    """Median of the ``size`` samples around each, mirrored at the edges (``size`` odd).

    A sorted window is kept while it slides, so the cost does not grow with
    the square of the window.
    """
    half = size // 2
    padded = x
    while len(padded) < len(x) + 2 * half:
        grow = min(half - (len(padded) - len(x)) // 2, len(padded))
        padded = np.pad(padded, grow, mode="symmetric")
    values = padded.tolist()
    window = sorted(values[:size])
    out = np.empty(len(x))
    out[0] = window[half]
    for i in range(1, len(x)):
        del window[bisect.bisect_left(window, values[i - 1])]
        bisect.insort(window, values[i + size - 1])
        out[i] = window[half]
    return out


# --- peaks -------------------------------------------------------------------


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict local maxima; a plateau counts at its middle (rounded down); ends never count."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))  # runs of equal values
    last = np.concatenate([first[1:], [len(x)]]) - 1
    level = x[first]
    inner = np.arange(1, len(level) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])] if len(level) > 2 else inner[:0]
    return (first[top] + last[top]) // 2


def prominence(x: np.ndarray, peak: int) -> float:
    """Height above the higher of the two lowest points towards higher ground on either side."""
    higher = x > x[peak]
    left = np.flatnonzero(higher[:peak])
    right = np.flatnonzero(higher[peak:])
    a = left[-1] + 1 if len(left) else 0
    b = peak + right[0] if len(right) else len(x)
    return float(x[peak] - max(x[a : peak + 1].min(), x[peak:b].min()))


def find_peaks(x: np.ndarray, height: float, distance: int, least_prominence: float) -> np.ndarray:
    """Local maxima that are high enough, then apart enough (the highest first), then prominent enough."""
    x = np.asarray(x, float)
    peaks = local_maxima(x)
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1].tolist():
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep &= ~near
    return np.array([p for p in peaks[keep].tolist() if prominence(x, p) >= least_prominence], dtype=int)


# --- level and rate ----------------------------------------------------------


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited change of the sample rate: spectra cut or extended, the signal mirrored at its ends."""
    x = np.asarray(x, float)
    if rate == target or not len(x):
        return x
    pad = min(len(x) - 1, rate // 10)
    step = rate // np.gcd(rate, target)
    pad -= pad % step
    ext = np.pad(x, pad, mode="reflect") if pad > 0 else x
    # whole periods of both rates, so that samples fall on the same instants
    ext = np.concatenate([ext, np.zeros(-len(ext) % step)])
    n = len(ext) * target // rate
    spectrum = np.fft.rfft(ext)
    out = np.zeros(n // 2 + 1, complex)
    m = min(len(spectrum), len(out))
    out[:m] = spectrum[:m]
    y = np.fft.irfft(out, n) * (n / len(ext))
    at = pad * target // rate
    return y[at : at + -(-len(x) * target // rate)]


def peak_normalised(x: np.ndarray) -> np.ndarray:
    return x / (np.abs(x).max() + 1e-8) if len(x) else x
