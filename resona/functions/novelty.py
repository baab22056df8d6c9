"""Novelty of one embedding sequence, with candidates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..errors import NoveltyError
from . import dsp

#: Context scales in frames and the gates of a peak.
SCALES, HEIGHT, PROMINENCE, DISTANCE = (2, 4), 0.20, 0.05, 2


@dataclass
class Candidate:
    time_sec: float
    score: float
    boundary: int
    scale: int


@dataclass
class Result:
    n_windows: int
    boundary_times: np.ndarray
    curve: np.ndarray
    scale_curves: dict[int, np.ndarray]
    candidates: list[Candidate] = field(default_factory=list)
    max_score: float = 0.0
    top3_mean: float = 0.0
    p95: float = 0.0
    strongest_time_sec: float | None = None
    local: dict[str, float] = field(default_factory=dict)
    note: str = ""

    @property
    def n_candidates(self) -> int:
        return len(self.candidates)


def _numbers(values, name: str, ndim: int) -> np.ndarray:
    x = np.asarray(values)
    if x.ndim != ndim or not x.size or np.iscomplexobj(x) or x.dtype == bool or not np.issubdtype(x.dtype, np.number):
        raise NoveltyError(f"{name}: a non-empty real array of {ndim} dimensions is required")
    x = x.astype(float)
    if not np.isfinite(x).all():
        raise NoveltyError(f"{name} must be finite")
    return x


def unit_rows(embeddings) -> np.ndarray:
    """Rows of length one; a zero row is an error."""
    e = _numbers(embeddings, "embeddings", 2)
    top = np.abs(e).max(axis=1, keepdims=True)
    if (top == 0).any():
        raise NoveltyError("an embedding is zero")
    e = e / top
    return e / np.sqrt((e * e).sum(axis=1, keepdims=True))


def similarity(embeddings) -> np.ndarray:
    """Cosine similarity of all frames, within -1..1, one on the diagonal."""
    u = unit_rows(embeddings)
    out = np.clip(u @ u.T, -1.0, 1.0)
    np.fill_diagonal(out, 1.0)
    return out


def kernel(scale: int) -> np.ndarray:
    """Checkerboard with Gaussian taper; the weights of either sign sum to one in size."""
    from ..operators.novelty import kernel as cells

    out = np.zeros((2 * scale, 2 * scale))
    for i, j, v in cells(scale):
        out[i, j] = v
    return out


def checked_times(times, n: int) -> np.ndarray:
    t = _numbers(times, "frame times", 1)
    if len(t) != n or (np.diff(t) <= 0).any():
        raise NoveltyError("frame times must rise, one per embedding")
    return t


def checked_scales(scales) -> tuple[int, ...]:
    s = tuple(scales)
    if not s or any(isinstance(x, bool) or not isinstance(x, (int, np.integer)) or x < 1 for x in s) or len(set(s)) != len(s):
        raise NoveltyError("scales must be distinct positive integers")
    return tuple(sorted(int(x) for x in s))


def checked_gates(height: float, prominence: float, distance: int) -> None:
    for name, v in (("height", height), ("prominence", prominence)):
        if isinstance(v, bool) or not np.isfinite(v) or v < 0:
            raise NoveltyError(f"peak {name} must be finite and not negative")
    if isinstance(distance, bool) or not isinstance(distance, (int, np.integer)) or distance < 1:
        raise NoveltyError("peak distance must be a positive integer")


def local_features(scores) -> dict[str, float]:
    """Maximum, minimum, range, largest step and 90th percentile of local scores."""
    s = _numbers(scores, "local scores", 1)
    return {
        "local_max": float(s.max()), "local_min": float(s.min()), "local_range": float(s.max() - s.min()),
        "local_max_jump": float(np.abs(np.diff(s)).max()) if len(s) > 1 else 0.0, "local_p90": float(np.percentile(s, 90)),
    }


def detect(embeddings, times, scales=SCALES, height: float = HEIGHT, prominence: float = PROMINENCE, distance: int = DISTANCE, local_scores=None) -> Result:
    """Novelty at every boundary between frames, and its significant peaks."""
    sim = similarity(embeddings)
    n = len(sim)
    t = checked_times(times, n)
    scales = checked_scales(scales)
    checked_gates(height, prominence, distance)
    local = {}
    if local_scores is not None:
        s = _numbers(local_scores, "local scores", 1)
        if len(s) != n or (s < 0).any() or (s > 1).any():
            raise NoveltyError("local scores must be in 0..1, one per embedding")
        local = local_features(s)
    at = np.concatenate([t[:1], (t[1:] + t[:-1]) / 2])
    curves, seen = {}, np.zeros(n, bool)
    for scale in scales:
        k, curve = kernel(scale), np.zeros(n)
        for b in range(scale, n - scale + 1):
            if b < n:
                curve[b] = max(0.0, float((sim[b - scale : b + scale, b - scale : b + scale] * k).sum()))
        inside = slice(scale, max(scale, min(n, n - scale + 1)))
        seen[inside] = True
        curves[scale] = curve
    best = np.max(list(curves.values()), axis=0)
    out = Result(n, at, best, curves, local=local)
    if not seen.any():
        out.note = "not enough windows for any context scale"
        return out
    values = best[seen]
    out.max_score, out.top3_mean = float(values.max()), float(np.sort(values)[::-1][:3].mean())
    out.p95 = float(np.percentile(values, 95))
    out.strongest_time_sec = float(at[np.flatnonzero(seen)[values.argmax()]])
    for p in dsp.find_peaks(best, height, distance, prominence).tolist():
        if seen[p]:
            scale = next(s for s in scales if curves[s][p] == best[p])
            out.candidates.append(Candidate(float(at[p]), float(best[p]), p, scale))
    if not np.isfinite([out.max_score, out.top3_mean, out.p95]).all():
        raise NoveltyError("the novelty is not finite")
    return out


def features(r: Result) -> dict[str, float]:
    out = {"novelty_max": r.max_score, "novelty_top3_mean": r.top3_mean, "novelty_p95": r.p95, "novelty_n_peaks": float(r.n_candidates)}
    return out | r.local
