import numpy as np
import pytest

from resona.errors import CepstralError, NoveltyError, SpliceError
from resona.functions import cepstral, dsp, mains, novelty, residual, splice

R = 16_000
T = np.arange(3 * R) / R
TONE = 0.25 * np.sin(2 * np.pi * 220 * T)
HALF = T < 1.5
GLIDE = 0.25 * np.sin(2 * np.pi * (180 * T + 820 / 3 * T * T / 2))


def best(y):
    r = splice.detect(y, R)
    return r, max(r.candidates, key=lambda c: c.score, default=None)


def test_clean_signals_have_no_candidates():
    for y in (TONE, GLIDE, np.linspace(0.08, 0.65, len(T)) * TONE * 4):
        r, _ = best(y)
        assert not r.candidates and r.max_score < 0.85


def test_level_step():
    r, c = best(np.where(HALF, 0.08, 0.65) * TONE * 4)
    assert r.max_level_db > 7 and abs(c.time_sec - 1.5) <= 0.08
    ramp, _ = best(np.linspace(0.08, 0.65, len(T)) * TONE * 4)
    assert r.max_score > 5 * ramp.max_score


def test_spectral_step_click_and_glide_with_level():
    _, c = best(np.where(HALF, TONE, 0.25 * np.sin(2 * np.pi * 880 * T)))
    assert abs(c.time_sec - 1.5) <= 0.08
    y = TONE.copy()
    y[24_000] += 1.5
    r, c = best(y)
    assert r.max_transient > 10 and c.kind == "transient" and abs(c.time_sec - 1.5) <= 0.04
    y = GLIDE.copy()
    y[24_000:] *= 3
    assert best(y)[1] is not None


def test_tonal_jump():
    h = T[:24_000]
    a = 0.25 * np.sin(2 * np.pi * (180 * h + 320 / 1.5 * h * h / 2))
    b = 0.25 * np.sin(2 * np.pi * (950 * h + 250 / 1.5 * h * h / 2))
    assert best(np.concatenate([a, b]))[1] is not None


def test_silence_short_and_invalid():
    r = splice.detect(np.zeros(R), R)
    assert r.note == splice.SILENT_NOTE and set(splice.features(np.zeros(R), R).values()) == {0.0}
    assert splice.detect(TONE[:500], R).note == splice.SHORT_NOTE
    for y, rate in (([], R), ([np.nan], R), ([np.inf], R), (np.zeros((2, 5)), R), (TONE, 22_050), (np.array([1j]), R), (np.array([True]), R)):
        with pytest.raises(SpliceError):
            splice.detect(y, rate)


def test_band_shift():
    v = np.array([1, 2, 3, 9])
    assert splice.shift_bands(v, 1).tolist() == [0, 1, 2, 3] and splice.shift_bands(v, -1).tolist() == [2, 3, 9, 0] and splice.shift_bands(v, 9).tolist() == [0] * 4


def test_wavelet_is_orthogonal_and_keeps_energy():
    h = np.array(dsp.SYM4)
    assert h.sum() == pytest.approx(2**0.5) and h @ h == pytest.approx(1)
    for shift in (2, 4, 6):
        assert h[shift:] @ h[:-shift] == pytest.approx(0, abs=1e-12)
    x = np.zeros(1024)
    x[300:700] = np.random.default_rng(1).normal(size=400)
    assert dsp.packet_energies(x, 4).sum() == pytest.approx((x * x).sum(), rel=1e-9)
    assert len(dsp.dwt(x, h)[0]) == (1024 + 7) // 2


def test_packet_bands_rise_in_frequency():
    for hz in (500, 1000, 3000, 6500):
        e = dsp.packet_energies(np.sin(2 * np.pi * hz * T), 7).sum(axis=1)
        assert abs((e.argmax() + 0.5) * 62.5 - hz) <= 62.5


def test_order_filters_match_a_loop():
    x = np.random.default_rng(2).normal(size=60)
    for size in (3, 9, 101):
        p = x
        while len(p) < len(x) + size - 1:
            p = np.pad(p, min(len(p), (len(x) + size - 1 - len(p) + 1) // 2), mode="symmetric")
        want = [p[i : i + size] for i in range(len(x))]
        assert dsp.moving_median(x, size).tolist() == [float(np.median(w)) for w in want]
        if size < 60:
            assert dsp.moving_maximum(x, size).tolist() == [float(w.max()) for w in want]


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 3, 0, 0.5, 0])
    assert dsp.local_maxima(x).tolist() == [1, 4, 7, 9]
    assert dsp.find_peaks(x, 1.0, 1, 0.0).tolist() == [1, 4, 7]
    assert dsp.find_peaks(x, 0.0, 4, 0.0).tolist() == [1, 7]
    assert dsp.prominence(np.array([0, 3, 1, 2, 0.0]), 3) == 1
    assert dsp.find_peaks(x, 0.0, 1, 1.5).tolist() == [4, 7]


def test_filters():
    taps = dsp.fir_lowpass()
    gain = lambda hz: abs((taps * np.exp(-2j * np.pi * hz / R * np.arange(101))).sum())
    assert gain(0) == pytest.approx(1) and gain(1000) == pytest.approx(0.5, abs=0.02) and gain(4000) < 1e-2
    x = np.random.default_rng(0).normal(size=500)
    assert np.allclose(dsp.fir_apply(x, taps), np.convolve(x, taps)[:500])
    t = np.arange(20_000) / 1000
    y = dsp.bandpass_zero_phase(np.sin(2 * np.pi * 60 * t) + np.sin(2 * np.pi * 55 * t), 1000, 59.4, 60.6)
    assert np.allclose(y[5000:-5000], np.sin(2 * np.pi * 60 * t)[5000:-5000], atol=0.02)


def test_resample_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(22_050) / 22_050)
    y = dsp.resample(x, 22_050, R)
    assert len(y) == R and np.allclose(y[500:-500], np.sin(2 * np.pi * 440 * np.arange(R) / R)[500:-500], atol=2e-3)


def test_dct_is_orthonormal():
    m = dsp.dct_matrix(20, 20)
    assert np.allclose(m @ m.T, np.eye(20))


@pytest.mark.parametrize("order", [1, 2])
def test_slopes_are_derivatives_of_fitted_polynomials(order):
    rows = np.cumsum(np.random.default_rng(40 + order).normal(size=(3, 31)), axis=1)
    got = dsp.slopes(rows, order)
    t = np.arange(-4, 5)
    for at in range(31):
        middle = min(max(at, 4), 26)  # at the edges the nearest whole fit holds
        for row, value in zip(rows, got[:, at], strict=True):
            fit = np.polynomial.Polynomial.fit(t, row[middle - 4 : middle + 5], order)
            assert value == pytest.approx(fit.deriv(order)(at - middle), abs=1e-9)
    with pytest.raises(ValueError):
        dsp.slopes(rows[:, :8], order)


def test_lfcc_and_residual_sizes():
    with pytest.raises(CepstralError):
        cepstral.lfcc(TONE[:1279])
    assert cepstral.lfcc(TONE).shape == (120,) and np.isfinite(cepstral.lfcc(TONE)).all()
    r = residual.residual(np.random.default_rng(0).normal(size=R))
    assert r.shape == (257,) and abs(r[2:10]).max() < 1 and r[200:].min() > 20


def test_lines_and_means_of_all_frames_at_once():
    rng = np.random.default_rng(3)
    x = np.arange(10, 513) / 10_000
    for n in (503, 502):
        y = rng.normal(size=(40, n))
        half = n // 2
        slope, level = cepstral._robust_lines(x[:n], y)
        for row, s, m in zip(y, slope, level, strict=True):
            one = np.median((row[half : 2 * half] - row[:half]) / (x[half : 2 * half] - x[:half]))
            assert s == one and m == np.median(row - one * x[:n])
    for size in (1, 5, 10):
        got = [cepstral._averaged(y[:, :30], size, axis) for axis in (0, 1)]
        assert np.allclose(got[0], cepstral._averaged(y[:, :30].T, size, 1).T)
        plain = [y[3, max(0, i - (size - 1) // 2) : min(30, i + size // 2 + 1)].mean() for i in range(30)]
        assert np.allclose(got[1][3], plain)


def test_cpps():
    tone = (0.2 * np.sin(2 * np.pi * 220 * np.arange(R) / R)).astype(np.float32)
    noise = np.random.default_rng(0).normal(size=R)
    assert cepstral.cpps(tone) == pytest.approx(15.719945, abs=0.4)  # the published value; ours is 15.325
    assert cepstral.cpps(tone) > cepstral.cpps(noise)
    for y, rate in ((tone, 22_050), (np.zeros((2, R)), R), ([], R), ([np.nan] * R, R), (np.zeros(R), R), (tone[: int(0.049 * R)], R)):
        with pytest.raises(CepstralError):
            cepstral.cpps(y, rate)


def test_mains_trace():
    t = np.arange(20 * 1000) / 1000
    hz = np.where(t < 10, 60.0, 60.3)
    times, freqs = mains.trace(np.sin(2 * np.pi * np.cumsum(hz) / 1000), 1000)
    assert freqs[0] == pytest.approx(60.0, abs=0.05) and freqs[-1] == pytest.approx(60.3, abs=0.05) and len(times) == len(freqs)
    assert mains.stability(np.full(5, 60.0))["verdict"] == "too_stable" and mains.stability(np.array([59, 61.0]))["verdict"] == "too_erratic"
    assert mains.stability(np.array([59.98, 60.02]))["verdict"] == "plausible"
    assert mains.parabolic_offset(np.array([1, 3, 2.0]), 1) == pytest.approx(1 / 6) and mains.parabolic_offset(np.array([1, 2.0]), 0) == 0


def times(n):
    return 0.4 + 0.2 * np.arange(n)


def blocks(*seeds, dim=16, n=15, noise=0.01):
    out = []
    for axis, seed in seeds:
        base = np.zeros(dim)
        base[axis] = 1
        out.append(base + np.random.default_rng(seed).normal(0, noise, (n, dim)))
    return np.concatenate(out)


def test_novelty_of_constant_abrupt_and_return():
    flat = novelty.detect(blocks((0, 1), n=30), times(30))
    assert flat.max_score < 0.01 and not flat.candidates
    r = novelty.detect(blocks((0, 2), (1, 3)), times(30))
    assert r.max_score > 0.8 and any(abs(c.time_sec - 3.3) <= 0.21 for c in r.candidates)
    aba = novelty.detect(blocks((0, 5), (1, 6), (0, 7), n=12), times(36))
    assert [round(c.time_sec, 1) for c in aba.candidates] == pytest.approx([2.7, 5.1], abs=0.25)


def test_novelty_of_drift_is_small():
    w = np.linspace(0, 1, 30)[:, None]
    base = blocks((0, 4), (1, 4), n=30)
    drift = novelty.detect((1 - w) * base[:30] + w * base[30:], times(30))
    assert drift.max_score < 0.1 * novelty.detect(blocks((0, 2), (1, 3)), times(30)).max_score


def test_novelty_short_invalid_and_local():
    r = novelty.detect(blocks((0, 15), n=3), times(3))
    assert r.max_score == 0 and r.strongest_time_sec is None and r.note
    e = blocks((0, 1), n=10)
    bad = [(e[0], times(10)), (e[:0], times(0)), (e * np.nan, times(10)), (e * 0, times(10)), (e, times(9)), (e, times(10)[::-1])]
    for x, t in bad:
        with pytest.raises(NoveltyError):
            novelty.detect(x, t)
    for kw in ({"scales": ()}, {"scales": (0,)}, {"scales": (2, 2)}, {"scales": (True,)}, {"height": -1}, {"distance": 0}, {"local_scores": [2.0] * 10}):
        with pytest.raises(NoveltyError):
            novelty.detect(e, times(10), **kw)
    f = novelty.features(novelty.detect(blocks((0, 2), (1, 3)), times(30), local_scores=[0.1] * 14 + [0.8, 0.9] + [0.95] * 14))
    assert f["local_max_jump"] == pytest.approx(0.7)


def test_novelty_does_not_move_with_time():
    e = blocks((0, 2), (1, 3))
    a, b = novelty.detect(e, times(30)), novelty.detect(e, times(30) + 100)
    assert novelty.features(a) == novelty.features(b) and b.strongest_time_sec == pytest.approx(a.strongest_time_sec + 100)


def test_kernel():
    k = novelty.kernel(2)
    assert k[0] == pytest.approx([0.036165, 0.098306, -0.098306, -0.036165], abs=1e-6) and k[1, 1] == pytest.approx(0.267223, abs=1e-6)
    assert k.sum() == pytest.approx(0, abs=1e-12)
