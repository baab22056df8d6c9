"""Mains hum: its frequency over time."""

from __future__ import annotations

import numpy as np

from . import dsp


def parabolic_offset(values: np.ndarray, k: int) -> float:
    """Sub-bin offset of the peak at ``k``; 0 at the edges and on straight lines."""
    if k <= 0 or k >= len(values) - 1:
        return 0.0
    a, b, c = values[k - 1 : k + 2]
    bend = a - 2 * b + c
    return float(0.5 * (a - c) / bend) if bend else 0.0


def trace(
    x, rate: int, nominal: float = 60.0, harmonic: int = 1, half_width: float = 0.6, seconds: float = 4.0, overlap: float = 0.75
) -> tuple[np.ndarray, np.ndarray]:
    """(times, frequencies) of the strongest bin near the harmonic, refined between bins and brought to the fundamental."""
    target = nominal * harmonic
    x = dsp.bandpass_zero_phase(np.asarray(x, float), rate, target - half_width * harmonic, target + half_width * harmonic)
    width = int(rate * seconds)
    if len(x) < width:
        return np.zeros(0), np.zeros(0)
    hop = width - int(width * overlap)
    size = np.abs(dsp.stft_plain(x, width, width - hop))
    hz = np.fft.rfftfreq(width, 1 / rate)
    band = np.flatnonzero((hz >= target - half_width * harmonic) & (hz <= target + half_width * harmonic))
    inner = size[band]
    peak = inner.argmax(axis=0)
    fine = [hz[band[k]] + parabolic_offset(inner[:, t], k) * hz[1] for t, k in enumerate(peak.tolist())]
    times = (np.arange(inner.shape[1]) * hop + width / 2) / rate
    return times, np.array(fine) / harmonic


def jumps(freqs: np.ndarray, threshold: float = 0.05, window: int = 5) -> list[int]:
    """Frames after a jump that is large and an outlier of its surroundings."""
    out = []
    for i, d in enumerate(np.abs(np.diff(freqs)).tolist()):
        spread = float(np.std(freqs[max(0, i - window) : i + window + 2]))
        if d > threshold and (d > 3 * spread or spread == 0):
            out.append(i + 1)
    return out


def stability(freqs: np.ndarray, least: float = 0.005, most: float = 0.08) -> dict:
    """Deviation of a trace and whether it is too_stable, too_erratic or plausible."""
    spread = float(np.std(freqs))
    return {"std": spread, "verdict": "too_stable" if spread < least else "too_erratic" if spread > most else "plausible"}
